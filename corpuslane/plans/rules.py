"""Queries of the fixed rules: guards, texts for search and prompts, headings, intents, relations and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslane.functions import rules as R
from corpuslane.functions import text as X
from corpuslane.operators import structure as S
from corpuslane.plans import search
from corpuslane.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _n(c) -> Column:
    return F.coalesce(c, F.lit(0)).cast("bigint")


@query("SELECT count(*) AS rows, count_if(starts_with(paper_id, 'sample_')) AS synthetic FROM paper_records")
def flt_synthetic_ids(spark, sf_dir):
    return table(spark, sf_dir, "paper_records").agg(F.count("*").alias("rows"), F.count_if(F.col("paper_id").startswith("sample_")).alias("synthetic"))


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) > 14000")
def flt_prompt_budget(spark, sf_dir):
    """Documents that would not fit a prompt."""
    return table(spark, sf_dir, "documents").where(F.length("text") > 14000).select("doc_id", F.length("text").cast("bigint").alias("chars"))


@query("""SELECT DISTINCT g.generation_id, CASE WHEN p.prompt_text IS NULL OR NOT regexp_matches(p.prompt_text, '[^ \\t\\n\\x0b\\f\\r]') THEN 'empty user;' ELSE '' END || CASE WHEN g.text IS NULL OR NOT regexp_matches(g.text, '[^ \\t\\n\\x0b\\f\\r]') THEN 'empty assistant;' ELSE '' END AS problems
FROM model_generations g LEFT JOIN (SELECT DISTINCT prompt_id, prompt_text FROM prompt_records) p USING (prompt_id)""")
def flt_message_problems(spark, sf_dir):
    g = table(spark, sf_dir, "model_generations").join(table(spark, sf_dir, "prompt_records").select("prompt_id", "prompt_text").distinct(), "prompt_id", "left")
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    messages = F.array(turn("system", F.lit("You answer questions on papers.")), turn("user", F.col("prompt_text")), turn("assistant", F.col("text")))
    problems = F.array_join(F.transform(R.message_problems(messages), lambda p: F.concat(p, F.lit(";"))), "")
    return g.select("generation_id", problems.alias("problems")).distinct()


@query("""WITH p AS (SELECT DISTINCT parsed_id, sections, reference_entries FROM parsed_papers), e AS (SELECT parsed_id, unnest(['background', 'experiments', 'related work', 'limitations', 'method', 'references']) AS expected, sections, reference_entries FROM p)
SELECT DISTINCT parsed_id, expected, CASE WHEN expected = 'references' THEN coalesce(len(reference_entries) > 0, false) ELSE coalesce(length(trim(sections[CASE expected WHEN 'background' THEN 'introduction' WHEN 'experiments' THEN 'results' WHEN 'related work' THEN 'related_work' ELSE expected END], ' ')) > 0, false) END AS present FROM e""")
def flt_sections_present(spark, sf_dir):
    p = table(spark, sf_dir, "parsed_papers").select("parsed_id", "sections", "reference_entries")
    asked = p.withColumn("expected", F.explode(F.array(*[F.lit(x) for x in ("background", "experiments", "related work", "limitations", "method", "references")])))
    return asked.select("parsed_id", "expected", R.section_present(F.col("sections"), F.col("reference_entries"), F.col("expected")).alias("present")).distinct()


@query("SELECT DISTINCT paper_id, coalesce(title, '') || ' ' || coalesce(abstract, '') AS search_text, coalesce(title, '') || '. ' || coalesce(abstract, '') AS class_text FROM paper_records")
def prj_retrieval_text(spark, sf_dir):
    t, a = F.col("title"), F.col("abstract")
    return table(spark, sf_dir, "paper_records").select("paper_id", R.retrieval_text(t, a).alias("search_text"), R.retrieval_text(t, a, ". ").alias("class_text")).distinct()


@query("""SELECT DISTINCT doc_id, CASE WHEN length(text) > 300 THEN left(text, 300) || E'\\n[... cut ...]\\n' ELSE text END AS head, CASE WHEN length(text) > 300 THEN left(text, 150) || E'\\n[... cut ...]\\n' || right(text, 150) ELSE text END AS both_ends FROM documents""")
def prj_capped_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", R.capped(F.col("text"), 300).alias("head"), R.capped(F.col("text"), 300, True).alias("both_ends")).distinct()


@query("SELECT DISTINCT paper_id, array_to_string(authors[:3], '; ') AS authors, array_to_string(categories[:3], '; ') AS categories FROM paper_records")
def prj_compact_pack(spark, sf_dir):
    """Papers as prompts name them: the first three authors and categories, no abstract."""
    first = lambda c: F.array_join(F.slice(c, 1, 3), "; ").alias(c)
    return table(spark, sf_dir, "paper_records").select("paper_id", first("authors"), first("categories")).distinct()


@query("""SELECT DISTINCT parsed_id, concat_ws(E'\\n', title, nullif(left(sections['abstract'], 1200), ''), nullif(left(sections['method'], 800), ''), nullif(left(sections['results'], 800), ''), nullif(left(sections['limitations'], 800), '')) AS context FROM parsed_papers""")
def prj_prompt_context(spark, sf_dir):
    return table(spark, sf_dir, "parsed_papers").select("parsed_id", R.prompt_context(F.col("title"), F.col("sections")).alias("context")).distinct()


@query(r"""SELECT DISTINCT paper_id, array_to_string(list_filter(reference_ids, lambda r: r IS NOT NULL AND regexp_matches(r, '^\d{4}\.\d{4,5}$')), ' ') AS refs, coalesce(citation_count, 0) AS citations, coalesce(influential_citation_count, 0) AS influential, coalesce(tldr, '') AS tldr, true AS enriched FROM paper_records""")
def prj_enriched_record(spark, sf_dir):
    refs = F.array_join(F.filter("reference_ids", lambda r: r.isNotNull() & r.rlike(r"^\d{4}\.\d{4,5}$")), " ")
    p = table(spark, sf_dir, "paper_records")
    return p.select("paper_id", refs.alias("refs"), F.coalesce("citation_count", F.lit(0)).alias("citations"), F.coalesce("influential_citation_count", F.lit(0)).alias("influential"), F.coalesce("tldr", F.lit("")).alias("tldr"), F.lit(True).alias("enriched")).distinct()


@query("""SELECT DISTINCT flat_id, CASE WHEN starts_with(categories, '[') THEN regexp_extract(categories, '^\\[\\s*[''"]([^''"]*)', 1) ELSE trim(categories, ' ') END AS first_category FROM flat_papers""")
def prj_first_item(spark, sf_dir):
    return table(spark, sf_dir, "flat_papers").select("flat_id", R.first_item(F.col("categories")).alias("first_category")).distinct()


@query("SELECT DISTINCT generation_id, coalesce(task, 'unknown') AS task, coalesce(latency_seconds, 0) AS latency, coalesce(error, '') AS error FROM model_generations")
def prj_typed_defaults(spark, sf_dir):
    g = table(spark, sf_dir, "model_generations")
    return g.select("generation_id", F.coalesce("task", F.lit("unknown")).alias("task"), F.coalesce("latency_seconds", F.lit(0.0)).alias("latency"), F.coalesce("error", F.lit("")).alias("error")).distinct()


@query("SELECT v.n AS vectors, d.n AS documents, v.n = d.n AS fits FROM (SELECT count(DISTINCT vec_id) AS n FROM embeddings) v, (SELECT count(DISTINCT doc_id) AS n FROM documents) d")
def src_vectors_fit_corpus(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").agg(F.count_distinct("vec_id").alias("vectors"))
    d = table(spark, sf_dir, "documents").agg(F.count_distinct("doc_id").alias("documents"))
    return v.crossJoin(d).withColumn("fits", F.col("vectors") == F.col("documents"))  # one row each


@query("SELECT doc_id FROM documents WHERE trim(text, E' \\n\\t\\r') <> '' ORDER BY doc_id LIMIT 100")
def top_first_valid(spark, sf_dir):
    """The first hundred documents that hold something, in order; the limit is the feature."""
    return table(spark, sf_dir, "documents").where(F.col("text").rlike(r"[^ \n\t\r]")).select("doc_id").orderBy("doc_id").limit(100)


@query("""SELECT DISTINCT f.flat_id, CASE WHEN t.tldr IS NOT NULL THEN 'summary' ELSE 'abstract' END AS source, coalesce(t.tldr, left(f.abstract, 300), '') AS card FROM flat_papers f
LEFT JOIN (SELECT paper_id, max(nullif(trim(tldr, ' '), '')) AS tldr FROM paper_records GROUP BY 1) t USING (paper_id)""")
def jn_summary_cards(spark, sf_dir):
    """Each paper with its summary, else the first 300 characters of its abstract."""
    t = table(spark, sf_dir, "paper_records").groupBy("paper_id").agg(F.max(F.nullif(F.trim("tldr"), F.lit(""))).alias("tldr"))
    f = table(spark, sf_dir, "flat_papers").select("flat_id", "paper_id", "abstract").distinct().join(t, "paper_id", "left")
    return f.select("flat_id", F.when(F.col("tldr").isNotNull(), "summary").otherwise("abstract").alias("source"), F.coalesce("tldr", F.substring("abstract", 1, 300), F.lit("")).alias("card")).distinct()


PAIRS = """p AS (SELECT DISTINCT parsed_id, list_transform(list_filter(coalesce(keywords, []), lambda x: x IS NOT NULL)[:10], lambda x: lower(x)) AS k, list_transform(list_filter(coalesce(entities.methods, []), lambda x: x IS NOT NULL), lambda x: lower(x)) AS g FROM parsed_papers),
k AS (SELECT parsed_id, g, unnest(k) AS x FROM p), kh AS (SELECT parsed_id, count(*) AS n, count_if(len(list_filter(g, lambda y: contains(x, y) OR contains(y, x))) > 0) AS h FROM k GROUP BY 1),
g AS (SELECT parsed_id, k, unnest(g) AS x FROM p), gh AS (SELECT parsed_id, count(*) AS n, count_if(len(list_filter(k, lambda y: contains(x, y) OR contains(y, x))) > 0) AS h FROM g GROUP BY 1),
m AS (SELECT p.parsed_id, round(coalesce(kh.h / kh.n, 0), 6) AS precision, round(coalesce(gh.h / gh.n, 0), 6) AS recall FROM (SELECT DISTINCT parsed_id FROM p) p LEFT JOIN kh USING (parsed_id) LEFT JOIN gh USING (parsed_id))"""


def _overlap(spark, sf_dir):
    p = table(spark, sf_dir, "parsed_papers")
    low = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()), F.lower)
    p = p.select("parsed_id", F.slice(low(F.col("keywords")), 1, 10).alias("k"), low(F.col("entities.methods")).alias("g")).distinct()
    met = lambda a, b: F.size(F.filter(a, lambda x: F.exists(b, lambda y: F.contains(x, y) | F.contains(y, x))))
    per = p.groupBy("parsed_id").agg(F.sum(met("k", "g")).alias("kh"), F.sum(F.size("k")).alias("kn"), F.sum(met("g", "k")).alias("gh"), F.sum(F.size("g")).alias("gn"))
    share = lambda h, n: F.round(F.when(F.col(n) > 0, F.col(h) / F.col(n)).otherwise(0.0), 6)
    return per.select("parsed_id", share("kh", "kn").alias("precision"), share("gh", "gn").alias("recall"))


@query(f"WITH {PAIRS} SELECT parsed_id, precision, recall FROM m")
def evl_keyword_overlap(spark, sf_dir):
    """Of ten keywords the share that names a stored method or lies in one's name, and of the methods the share that is met so."""
    return _overlap(spark, sf_dir)


@query(f"WITH {PAIRS} SELECT count(*) AS papers, round(coalesce(avg(precision), 0), 5) AS precision, round(coalesce(avg(recall), 0), 5) AS recall FROM m")
def evl_keyword_overlap_macro(spark, sf_dir):
    return _overlap(spark, sf_dir).agg(F.count("*").alias("papers"), F.round(F.coalesce(F.avg("precision"), F.lit(0.0)), 5).alias("precision"), F.round(F.coalesce(F.avg("recall"), F.lit(0.0)), 5).alias("recall"))


@query("SELECT user_id, min(event_id) AS first_event, min(ts) AS first_ts, count(*) AS events FROM events GROUP BY 1")
def win_turn_order(spark, sf_dir):
    """Turns (users) in the order in which they are first seen: the least event of each."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.min("ts").alias("first_ts"), F.count("*").alias("events"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def str_latest_state(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query(f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}'), lambda t: t NOT IN ({search.STOP}))) AS words FROM documents")
def txt_abstract_words(spark, sf_dir):
    stop = F.array(*[F.lit(w) for w in X.STOP_WORDS])
    words = F.filter(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z]{3,})"), 1), lambda t: ~F.array_contains(stop, t))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("bigint").alias("words"))


@query("SELECT DISTINCT prompt_id, regexp_replace(trim(replace(prompt_text, chr(8217), ''''), ' '), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS query, regexp_replace(regexp_replace(trim(prompt_text, ' '), '[?.!]+$', ''), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g') AS topic FROM prompt_records")
def txt_normal_query(spark, sf_dir):
    return table(spark, sf_dir, "prompt_records").select("prompt_id", R.normal_query(F.col("prompt_text")).alias("query"), R.normal_topic(F.col("prompt_text")).alias("topic")).distinct()


ASKS = """asks AS (SELECT DISTINCT prompt_id AS id, prompt_text AS t FROM prompt_records UNION SELECT DISTINCT paper_id, 'Please suggest some papers on ' || title || '?' FROM paper_records WHERE title <> '' UNION SELECT DISTINCT 'T' || prompt_id, 'Thanks ' || prompt_text FROM prompt_records)"""


def _asks(spark, sf_dir):
    """Prompts, requests for papers on the titles of papers, and thanks."""
    p, r = table(spark, sf_dir, "prompt_records"), table(spark, sf_dir, "paper_records")
    wanted = r.where("title <> ''").select(F.col("paper_id").alias("id"), F.concat(F.lit("Please suggest some papers on "), "title", F.lit("?")).alias("t"))
    return p.select(F.col("prompt_id").alias("id"), F.col("prompt_text").alias("t")).unionByName(wanted).unionByName(p.select(F.concat(F.lit("T"), "prompt_id").alias("id"), F.concat(F.lit("Thanks "), "prompt_text").alias("t"))).distinct()


@query(rf"""WITH {ASKS}, q AS (SELECT id, t, regexp_replace(trim(replace(t, chr(8217), ''''), ' '), '[ \t\n\x0b\f\r]+', ' ', 'g') AS q FROM asks)
SELECT id, regexp_replace(nullif(regexp_extract(q, '(?i)(?:suggest|recommend|find|show|list|give +me) +(?:me +)?(?:(?:some|[0-9]+|one|two|three|four|five|six|seven|eight|nine|ten) +)?(?:research +)?papers? +(?:on|about|for|regarding) +(.+)', 1), ''), '[?.!]+$', '') AS topic,
regexp_matches(q, '(?i)^(?:thanks|thank +you|cheers)(?: +.*)?[!,. ]*$') AS chit_chat FROM q""")
def rte_intent(spark, sf_dir):
    return _asks(spark, sf_dir).select("id", R.recommendation_topic(F.col("t")).alias("topic"), R.is_chit_chat(F.col("t")).alias("chit_chat"))


@query("""WITH p AS (SELECT DISTINCT prompt_id, trim(replace(replace(prompt_text, '"', ''), '\\', ''), ' ') AS t, CAST(substr(prompt_id, 2) AS INT) AS k FROM prompt_records) SELECT prompt_id, t AS query, greatest(1, least(k, 20)) AS top_k FROM p WHERE k % 3 <> 0 AND t <> ''""")
def rte_tool_calls(spark, sf_dir):
    """Calls read back from answers: every third calls another tool and is dropped."""
    p = table(spark, sf_dir, "prompt_records").select("prompt_id", F.regexp_replace("prompt_text", r'["\\]', "").alias("t"), F.expr("cast(substr(prompt_id, 2) as int)").alias("k")).distinct()
    call = F.concat(F.lit('Let me see.\n```json\n{"tool": "'), F.when(F.col("k") % 3 == 0, "other").otherwise("search_offline"), F.lit('", "arguments": {"query": "'), F.regexp_replace("t", r"\s", " "), F.lit('", "top_k": '), F.col("k").cast("string"), F.lit("}}\n```"))
    return p.select("prompt_id", R.tool_call(call).alias("c")).where("c is not null").select("prompt_id", "c.query", "c.top_k")


MARKS = " + ".join(f"CAST(contains(lower(text), '{m}') AS INT)" for m in ("strengths", "weaknesses", "recommended", "gap", "summary", "evidence"))


@query(f"""WITH g AS (SELECT DISTINCT generation_id, strategy, text FROM model_generations WHERE text IS NOT NULL), s AS (SELECT generation_id, strategy, least(1.0, 0.55 + 0.09 * ({MARKS})) AS base, regexp_matches(text, '\\[S[0-9]+\\]') AS cites FROM g),
x AS (SELECT generation_id, base, CASE WHEN strategy = 'few_shot' THEN least(1.0, base + 0.08) ELSE base END AS structure, CASE WHEN cites THEN 0.5 ELSE 1.0 END AS evidence, strategy FROM s)
SELECT generation_id, round(CAST(structure AS DOUBLE), 2) AS structure, CAST(evidence AS DOUBLE) AS evidence, CASE WHEN strategy = 'few_shot' AND evidence >= 0.5 THEN 0 WHEN base >= 0.73 AND evidence >= 0.8 THEN 0 ELSE 1 END AS format_error FROM x""")
def grd_output_score(spark, sf_dir):
    """Scores of outputs without an evidence pack, where every cited source is unsupported."""
    g = table(spark, sf_dir, "model_generations").where("text is not null").select("generation_id", "strategy", "text").distinct()
    few = F.coalesce(F.col("strategy") == "few_shot", F.lit(False))
    evidence = F.when(F.col("text").rlike(r"\[S[0-9]+\]"), 0.5).otherwise(1.0)
    error = F.when(few & (evidence >= 0.5), 0).when((F.round(R.structure_score(F.col("text"), F.lit(False)), 6) >= 0.73) & (evidence >= 0.8), 0).otherwise(1)
    return g.select("generation_id", F.round(F.round(R.structure_score(F.col("text"), few), 6), 2).alias("structure"), evidence.alias("evidence"), error.alias("format_error"))


@query("""WITH g AS (SELECT prompt_id, generation_id, json_extract_string(CASE WHEN json_valid(text) THEN text END, '$.summary') AS summary FROM model_generations WHERE starts_with(text, '{')) SELECT prompt_id, arg_min(summary, generation_id) AS summary, count(DISTINCT generation_id) AS answers FROM g WHERE summary <> '' GROUP BY 1""")
def grd_first_summary(spark, sf_dir):
    """The first summary of each prompt wins."""
    g = table(spark, sf_dir, "model_generations").where(F.col("text").startswith("{"))
    s = g.select("prompt_id", "generation_id", F.when(F.try_parse_json("text").isNotNull(), F.get_json_object("text", "$.summary")).alias("summary")).where("summary <> ''")
    return s.groupBy("prompt_id").agg(F.min_by("summary", "generation_id").alias("summary"), F.count_distinct("generation_id").alias("answers"))


@query("""WITH k AS (SELECT coalesce(doc_kind, '-') AS k, count(*) AS n FROM documents GROUP BY 1) SELECT '| kind | documents |' || chr(10) || '|-|-|' || chr(10) || string_agg('| ' || k || ' | ' || n || ' |', chr(10) ORDER BY k) AS report FROM k""")
def snk_markdown_table(spark, sf_dir):
    """A Markdown table of counts; one row a kind, so what is joined is small."""
    k = table(spark, sf_dir, "documents").groupBy(F.coalesce("doc_kind", F.lit("-")).alias("k")).agg(F.count("*").alias("n"))
    lines = F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("| "), "k", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("line"))))
    return k.agg(F.concat(F.lit("| kind | documents |\n|-|-|\n"), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("report"))


BODY = "regexp_replace(regexp_replace(trim(line, ' '), '^[0-9]+([.][0-9]+)*[ \\t]*', ''), '[ \\t]+', ' ', 'g')"
KEY = f"lower(regexp_replace(regexp_replace({BODY}, '^[ .:-]+', ''), '[ .:-]+$', ''))"
#: Sections put together as one text with numbered headings, and its lines.
RAW = f"""pp AS (SELECT DISTINCT parsed_id, list_sort(list_filter(map_entries(sections), lambda e: length(trim(coalesce(e.value, ''), ' ')) > 0)) AS m FROM parsed_papers), t AS (SELECT parsed_id, string_split(array_to_string(list_transform(m, lambda e, i: i || ' ' || array_to_string(list_transform(string_split(e.key, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || chr(10) || e.value), chr(10)), chr(10)) AS l FROM pp),
l AS (SELECT parsed_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM t), o AS (SELECT *, regexp_matches(line, '^[0-9]+([.][0-9]+)*[ \\t]+[A-Z].{{0,120}}$') AND NOT (regexp_matches(lower(line), '\\b(figure|table|algorithm|appendix)\\b') AND NOT regexp_matches(line, '^[0-9]+[ \\t]+[A-Z]')) AS opens, {KEY} AS k FROM l),
h AS (SELECT *, CASE WHEN NOT opens THEN NULL WHEN k = 'abstract' THEN 'abstract' WHEN regexp_matches(k, '^acknowledge?ments$') THEN NULL WHEN regexp_matches(k, '^(introduction|background|preliminaries)') THEN 'introduction' WHEN regexp_matches(k, '^(method|approach|model|algorithm|framework|architecture|proposed)') THEN 'method'
 WHEN regexp_matches(k, '^(results|experiments|experimental|evaluation|empirical|findings)') THEN 'results' WHEN regexp_matches(k, '^(conclusion|future work|summary)') THEN 'conclusion' WHEN regexp_matches(k, '^(related work|prior work|literature review)') THEN 'related_work' WHEN regexp_matches(k, '^limitation') THEN 'limitations' WHEN starts_with(k, 'discussion') THEN 'discussion' END AS section FROM o)"""


def _raw(spark, sf_dir):
    return table(spark, sf_dir, "parsed_papers").select("parsed_id", S.numbered_text(F.col("sections")).alias("text")).distinct()


@query(f"WITH {RAW} SELECT parsed_id, line_no, line AS heading, section FROM h WHERE opens")
def doc_numbered_headings(spark, sf_dir):
    return S.heading_lines(_raw(spark, sf_dir), "parsed_id").where("opens").select("parsed_id", "line_no", F.col("line").alias("heading"), "section")


@query(f"""WITH {RAW}, b AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY parsed_id ORDER BY line_no) AS b FROM h), g AS (SELECT parsed_id, b, max(section) AS section, trim(string_agg(CASE WHEN NOT opens THEN line END, chr(10) ORDER BY line_no), ' ') AS body FROM b WHERE b > 0 GROUP BY 1, 2)
SELECT parsed_id, section, string_agg(body, chr(10) || chr(10) ORDER BY b) AS body FROM g WHERE section <> 'abstract' AND body <> '' GROUP BY 1, 2""")
def doc_split_sections(spark, sf_dir):
    return S.split_sections(_raw(spark, sf_dir), "parsed_id")


@query(r"""WITH e AS (SELECT DISTINCT unnest(reference_entries) AS e FROM parsed_papers), x AS (SELECT e, length(e) AS n, len(list_filter(regexp_extract_all(e, '[0-9]+'), lambda d: regexp_matches(d, '^(18|19|20)[0-9][0-9]$'))) AS years, regexp_matches(e, '^\p{Lu}') AND NOT regexp_matches(e, '^(?:In|Proceedings|International|Journal|Conference|University)\b') AND
 (regexp_matches(e, '^\p{Lu}[\p{L}''’\-]+,\s+\p{Lu}\.?(?:\s+\p{Lu}\.?)?') OR regexp_matches(e, '(?i)^[^.!?]{1,120}\bet\s+al\.') OR regexp_matches(e, '^\p{Lu}[\p{L}''’\-]+(?:\s+(?:\p{Lu}\.|\p{Lu}[\p{L}''’\-]+)){1,6}(?:,|\s+and\b|\s+et\s+al\.|\.\s+)') OR regexp_matches(regexp_replace(e, '\.\s+\p{Lu}.*$', '', 's'), '(?i)\b(?:and|&)\b') OR length(e) - length(replace(e, ',', '')) >= 2) AS author FROM e WHERE e IS NOT NULL)
SELECT e AS entry, CAST(CASE WHEN author THEN 2.0 ELSE 0 END + CASE WHEN years > 0 THEN 2.0 ELSE 0 END + CASE WHEN n BETWEEN 40 AND 450 THEN 1.0 ELSE 0 END - CASE WHEN n < 30 THEN 4.0 ELSE 0 END - CASE WHEN n > 600 THEN 3.0 + (n - 600) / 200 ELSE 0 END - CASE WHEN years > 2 THEN (years - 2) * 2.0 ELSE 0 END - CASE WHEN NOT author OR years = 0 THEN 2.0 ELSE 0 END AS DOUBLE) AS score FROM x""")
def scl_reference_scores(spark, sf_dir):
    e = table(spark, sf_dir, "parsed_papers").select(F.explode("reference_entries").alias("entry")).where("entry is not null").distinct()
    return e.select("entry", S.entry_score(F.col("entry")).alias("score"))


@query()
def doc_split_references(spark, sf_dir):
    """Stored entries joined to one list and split again, by numbers, authors or lines."""
    p = table(spark, sf_dir, "parsed_papers").select("parsed_id", F.array_join("reference_entries", "\n").alias("tail")).distinct()
    return p.select("parsed_id", F.posexplode(S.split_references(F.col("tail"))).alias("at", "entry"))


@query()
def doc_extracted_abstracts(spark, sf_dir):
    return _raw(spark, sf_dir).select("parsed_id", S.abstract_of(F.col("text")).alias("abstract"))


@query("""WITH q AS (SELECT DISTINCT prompt_id, trim(prompt_text, ' ') AS q FROM prompt_records) SELECT prompt_id, v.variant, CASE v.variant WHEN 'plain' THEN q WHEN 'doubled' THEN q || ' ' || q ELSE 'This paper presents work on ' || q || '.' END AS text FROM q, (SELECT unnest(['plain', 'doubled', 'pseudo_abstract']) AS variant) v""")
def ret_query_variants(spark, sf_dir):
    q = F.trim("prompt_text")
    made = {"plain": q, "doubled": F.concat_ws(" ", q, q), "pseudo_abstract": F.concat(F.lit("This paper presents work on "), q, F.lit("."))}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("variant"), c.alias("text")) for k, c in made.items()])).alias("v")
    return table(spark, sf_dir, "prompt_records").select("prompt_id", rows).select("prompt_id", "v.*").distinct()


@query(f"""WITH f AS ({search.ORACLE['ret_rrf']}), t AS (SELECT doc_id, max(paper_id) AS title FROM documents GROUP BY 1) SELECT query_id, doc_id, rank, round(score, 4) AS score,
'Recommended due to ' || CASE WHEN bm25_rank > 0 AND tfidf_rank > 0 AND bm25_rank <= tfidf_rank THEN 'strong term-frequency match with query and semantic alignment' WHEN tfidf_rank > 0 THEN 'high semantic similarity between query and abstract' ELSE 'strong term-frequency match with query' END || '. Title: "' || coalesce(title, '') || '".' AS reason,
CASE WHEN tfidf_rank > 0 AND (bm25_rank = 0 OR tfidf_rank < bm25_rank) THEN 'similar' ELSE 'same_topic' END AS relation, CASE WHEN rank = 1 THEN 'method_related' WHEN score > 0.85 THEN 'similar' WHEN rank <= 3 THEN 'foundational' ELSE 'recent' END AS place FROM f LEFT JOIN t USING (doc_id)""")
def ret_recommend(spark, sf_dir):
    """Fused hits with the reason, and the relation by ranks and by place; the paper's id stands for its title."""
    fused = search.QUERIES["ret_rrf"](spark, sf_dir)
    titles = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.max("paper_id").alias("title"))
    b, v = F.col("bm25_rank"), F.col("tfidf_rank")
    return fused.join(titles, "doc_id", "left").select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"), R.reason_by_ranks(b, v, F.col("title")).alias("reason"), R.relation_by_ranks(b, v).alias("relation"), R.relation_by_place(F.col("score"), F.col("rank") - 1).alias("place"))


CLASSES = """g AS (SELECT DISTINCT generation_id, g.prompt_id, coalesce(g.task, '-') AS said, p.task AS actual FROM model_generations g JOIN (SELECT DISTINCT prompt_id, task FROM prompt_records) p USING (prompt_id)), c AS (SELECT actual, said, count(*) AS n FROM g GROUP BY 1, 2)"""


def _confusion(spark, sf_dir):
    p = table(spark, sf_dir, "prompt_records").select("prompt_id", F.col("task").alias("actual")).distinct()
    g = table(spark, sf_dir, "model_generations").select("generation_id", "prompt_id", F.coalesce("task", F.lit("-")).alias("said")).distinct()
    return g.join(p, "prompt_id").groupBy("actual", "said").agg(F.count("*").alias("n"))


@query(f"WITH {CLASSES} SELECT actual, said, n FROM c")
def evl_confusion(spark, sf_dir):
    """Tasks written on responses against those of their prompts."""
    return _confusion(spark, sf_dir)


@query(f"""WITH {CLASSES}, a AS (SELECT actual AS k, sum(n) AS support, sum(CASE WHEN actual = said THEN n ELSE 0 END) AS hit FROM c GROUP BY 1), s AS (SELECT said AS k, sum(n) AS claimed FROM c GROUP BY 1),
f AS (SELECT k, support, hit, coalesce(2.0 * hit / nullif(support + coalesce(claimed, 0), 0), 0) AS f1 FROM a LEFT JOIN s USING (k)) SELECT CAST(sum(support) AS BIGINT) AS rows, round(sum(hit) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1, round(max(support) / sum(support), 6) AS majority FROM f""")
def evl_classification_summary(spark, sf_dir):
    """Accuracy, macro and weighted F1, and the share of the commonest class, from the confusion counts."""
    c = _confusion(spark, sf_dir)
    a = c.groupBy(F.col("actual").alias("k")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("said"), F.col("n")).otherwise(0)).alias("hit"))
    s = c.groupBy(F.col("said").alias("k")).agg(F.sum("n").alias("claimed"))
    f = a.join(s, "k", "left").withColumn("f1", 2.0 * F.col("hit") / (F.col("support") + _n(F.col("claimed"))))
    r = lambda x, name: F.round(x, 6).alias(name)
    return f.agg(F.sum("support").alias("rows"), r(F.sum("hit") / F.sum("support"), "accuracy"), r(F.avg("f1"), "macro_f1"), r(F.sum(F.col("f1") * F.col("support")) / F.sum("support"), "weighted_f1"), r(F.max("support") / F.sum("support"), "majority"))


@query("""WITH p AS (SELECT paper_id, max(TRY_CAST(left(published_date, 4) AS INT)) AS y FROM paper_records GROUP BY 1), r AS (SELECT paper_id, CASE WHEN y IS NULL THEN 0.5 ELSE greatest(0.0, 1.0 - greatest(0, 2024 - y) * 0.1) END AS recency FROM p)
SELECT paper_id, CASE WHEN round(recency, 6) >= 0.8 THEN 'recent' WHEN round(recency, 6) < 0.2 THEN 'foundational' ELSE 'similar' END AS relation FROM r""")
def scl_relation(spark, sf_dir):
    year = F.max(F.substring("published_date", 1, 4).try_cast("int")).alias("y")
    p = table(spark, sf_dir, "paper_records").groupBy("paper_id").agg(year)
    recency = F.round(F.when(F.col("y").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - F.greatest(F.lit(0), 2024 - F.col("y")) * 0.1)), 6)
    none = F.lit(0.0)
    return p.select("paper_id", R.relation_by_signals(recency, none, none, none).alias("relation"))


@query(f"""WITH x AS ({search.ORACLE['evl_compare_retrievers']}) SELECT max(CASE WHEN component = 'bm25' THEN precision END) AS bm25, max(CASE WHEN component = 'tfidf' THEN precision END) AS tfidf, round(max(CASE WHEN component = 'tfidf' THEN precision END) - max(CASE WHEN component = 'bm25' THEN precision END), 4) AS delta FROM x""")
def evl_retriever_delta(spark, sf_dir):
    """Precision of two retrievers side by side, with the difference."""
    x = search.evl_compare_retrievers(spark, sf_dir)
    of = lambda c: F.max(F.when(F.col("component") == c, F.col("precision")))
    return x.agg(of("bm25").alias("bm25"), of("tfidf").alias("tfidf"), F.round(of("tfidf") - of("bm25"), 4).alias("delta"))


@query(f"SELECT weight, hits FROM ({search.ORACLE['evl_weight_grid']}) ORDER BY hits DESC, weight LIMIT 10")
def top_best_weights(spark, sf_dir):
    return search.QUERIES["evl_weight_grid"](spark, sf_dir).orderBy(F.desc("hits"), "weight").limit(10)


@query("""WITH a AS (SELECT DISTINCT paper_id, list_filter(list_transform(authors, lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM paper_records) SELECT paper_id, array_to_string(l, '|') AS all_authors, CASE WHEN coalesce(len(l), 0) = 0 THEN 'none' WHEN len(l) <= 2 THEN 'named' ELSE 'et al.' END AS form FROM a""")
def txt_aps_forms(spark, sf_dir):
    p = table(spark, sf_dir, "paper_records").select("paper_id", "authors").distinct()
    shown = R.aps_authors(F.col("authors"))
    kept = F.filter(F.transform("authors", F.trim), lambda x: x != "")
    return p.select("paper_id", F.array_join(kept, "|").alias("all_authors"), F.when(shown == "Unknown author", "none").when(shown.endswith(" et al."), "et al.").otherwise("named").alias("form")).distinct()
