"""Text, structure and grounding queries over documents, parsed papers, prompts and generations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslane.functions import scalars as S
from corpuslane.functions import text as X
from corpuslane.operators import documents as D
from corpuslane.plans.search import TOKENS
from corpuslane.operators.records import one_text
from corpuslane.runtime import table

QUERIES, ORACLE = {}, {}
TOK = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')"
DOCS = "d AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark, sf_dir):
    return one_text(table(spark, sf_dir, "documents"))


def generations(spark, sf_dir):
    return table(spark, sf_dir, "model_generations").select("generation_id", "prompt_id", "text").distinct()


def _n(c):
    return F.coalesce(F.size(c), F.lit(0)).cast("bigint")


@query(f"WITH {DOCS} SELECT doc_id, coalesce(len({TOK}), 0) AS tokens, coalesce(len({TOKENS('text')}), 0) AS content, coalesce(len(regexp_extract_all(lower(text), '[a-z0-9]+')), 0) AS alnum, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')), 0) AS words FROM d")
def txt_token_counts(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return docs(spark, sf_dir).select("doc_id", _n(X.tokens(t)).alias("tokens"), _n(X.content_tokens(t)).alias("content"), _n(X.alnum_tokens(t)).alias("alnum"), X.word_count(t).cast("bigint").alias("words"))


@query(f"""WITH {DOCS}, w AS (SELECT doc_id, {TOKENS('text')} AS w FROM d), g AS (SELECT doc_id, unnest(list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || '_' || z[2])) AS bigram FROM w WHERE len(w) >= 2)
SELECT bigram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY bigram ORDER BY n DESC, bigram LIMIT 100""")
def txt_top_bigrams(spark, sf_dir):
    g = docs(spark, sf_dir).select("doc_id", F.explode(X.bigrams(X.content_tokens(F.col("text")), "_")).alias("bigram")).groupBy("bigram", "doc_id").agg(F.count("*").alias("c"))
    return g.groupBy("bigram").agg(F.sum("c").alias("n"), F.count("*").alias("docs")).orderBy(F.desc("n"), "bigram").limit(100)


@query(f"WITH {DOCS}, s AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text, E' '), '([.!?])[ \\t\\n\\x0b\\f\\r]+', E'\\\\1\\x1f', 'g'), E'\\x1f'), lambda x: x <> '') AS s FROM d WHERE text IS NOT NULL) SELECT doc_id, len(s) AS sentences FROM s")
def txt_sentence_counts(spark, sf_dir):
    return docs(spark, sf_dir).where("text is not null").select("doc_id", _n(X.sentences(F.col("text"))).alias("sentences"))


ROLE = {r: " + ".join(f"CAST(contains(l, '{c}') AS INT)" for c in cues) for r, cues in X.ROLE_CUES.items()}


@query(f"""WITH {DOCS}, s AS (SELECT doc_id, lower(unnest(list_filter(string_split(regexp_replace(trim(text, E' '), '([.!?])[ \\t\\n\\x0b\\f\\r]+', E'\\\\1\\x1f', 'g'), E'\\x1f'), lambda x: x <> ''))) AS l FROM d WHERE text IS NOT NULL),
c AS (SELECT doc_id, {ROLE['method']} AS m, {ROLE['results']} AS r, {ROLE['background']} AS b FROM s)
SELECT CASE WHEN m > 0 AND m >= r AND m >= b THEN 'method' WHEN r > 0 AND r >= b THEN 'results' WHEN b > 0 THEN 'background' ELSE 'other' END AS role, count(*) AS sentences, count(DISTINCT doc_id) AS docs FROM c GROUP BY 1""")
def txt_sentence_roles(spark, sf_dir):
    s = docs(spark, sf_dir).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy(X.sentence_role(F.col("s")).alias("role")).agg(F.count("*").alias("sentences"), F.count_distinct("doc_id").alias("docs"))


@query(f"WITH {DOCS} SELECT doc_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k, sha256(text) AS sha FROM d WHERE text IS NOT NULL")
def txt_normal_key_sha(spark, sf_dir):
    return docs(spark, sf_dir).where("text is not null").select("doc_id", X.normal_key(F.col("text")).alias("k"), F.sha2("text", 256).alias("sha"))


@query(f"WITH {DOCS} SELECT sha256(text) AS sha, min(doc_id) AS first_doc, count(*) AS copies FROM d WHERE text IS NOT NULL GROUP BY 1")
def win_first_seen_text(spark, sf_dir):
    return docs(spark, sf_dir).where("text is not null").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query("""WITH q AS (SELECT DISTINCT prompt_id, trim(prompt_text, ' ') AS t FROM prompt_records UNION SELECT DISTINCT 'D' || doc_id, trim(text, ' ') FROM documents WHERE regexp_matches(text, '(?i)scientific literature|augmented'))
SELECT prompt_id, t || CASE WHEN regexp_matches(t, '(?i)\\bretrieval[\\s-]+augmented[\\s-]+generation\\b') THEN ' RAG retrieval-augmented generation' ELSE '' END || CASE WHEN contains(lower(t), 'scientific literature') THEN ' scientific papers scholarly documents' ELSE '' END AS expanded FROM q""")
def txt_expand_query(spark, sf_dir):
    held = table(spark, sf_dir, "documents").where(F.col("text").rlike("(?i)scientific literature|augmented")).select(F.concat(F.lit("D"), "doc_id").alias("prompt_id"), F.col("text").alias("prompt_text"))
    every = table(spark, sf_dir, "prompt_records").select("prompt_id", "prompt_text").unionByName(held)
    return every.select("prompt_id", X.expand_query(F.col("prompt_text")).alias("expanded")).distinct()


GEN = "g AS (SELECT DISTINCT generation_id, prompt_id, text FROM model_generations)"
IDS = """list_sort(list_distinct(list_concat(regexp_extract_all(text, '\\d{4}\\.\\d{4,5}'), list_filter(flatten(list_transform(regexp_extract_all(text, '\\[([^\\[\\]]+)\\]', 1), lambda t: list_transform(regexp_split_to_array(t, '[,;]'), lambda x: trim(x)))), lambda x: regexp_full_match(x, 'S\\d+|\\d{4}\\.\\d{4,5}(v\\d+)?')))))"""


@query(f"WITH {GEN} SELECT generation_id, array_to_string({IDS}, ',') AS ids FROM g WHERE text IS NOT NULL")
def txt_source_ids(spark, sf_dir):
    return generations(spark, sf_dir).where("text is not null").select("generation_id", F.array_join(X.output_source_ids(F.col("text")), ",").alias("ids"))


@query(f"""WITH {GEN}, i AS (SELECT generation_id, {IDS} AS used FROM g WHERE text IS NOT NULL), c AS (SELECT generation_id, used, list_filter(used, lambda x: x NOT IN ('S1','S2','S3','S4')) AS bad FROM i)
SELECT generation_id, len(used) AS used, len(bad) AS unsupported, len(used) > 0 AND len(bad) = 0 AS passed FROM c""")
def grd_check_generation(spark, sf_dir):
    return D.check_citations(generations(spark, sf_dir), ["S1", "S2", "S3", "S4"])


@query(f"""WITH {GEN}, i AS (SELECT prompt_id, {IDS} AS used FROM g WHERE text IS NOT NULL), c AS (SELECT prompt_id, len(used) AS u, len(list_filter(used, lambda x: x NOT IN ('S1','S2','S3','S4'))) AS b FROM i)
SELECT p.task, count(*) AS outputs, count_if(b = 0) AS clean, round(100.0 * count_if(b = 0) / count(*), 4) AS pct_clean FROM c JOIN (SELECT DISTINCT prompt_id, task FROM prompt_records) p USING (prompt_id) GROUP BY p.task""")
def grd_faithfulness_audit(spark, sf_dir):
    p = table(spark, sf_dir, "prompt_records").select("prompt_id", "task").distinct()
    return D.faithfulness(generations(spark, sf_dir), p, ["S1", "S2", "S3", "S4"])


@query(f"""WITH {DOCS}, t AS (SELECT DISTINCT CAST(substr(prompt_id, 2) AS BIGINT) AS query_id, list_distinct(list_filter({TOKENS('prompt_text')}, lambda x: length(x) > 2)) AS terms FROM prompt_records),
x AS (SELECT query_id, unnest(terms) AS term, len(terms) AS n FROM t), p AS (SELECT DISTINCT doc_id, unnest({TOKENS('text')}) AS term FROM d), m AS (SELECT query_id, doc_id, count(*) / max(n) AS share FROM x JOIN p USING (term) GROUP BY 1, 2)
SELECT query_id, count_if(share >= 0.6) AS eligible, count_if(share >= 0.25 AND share < 0.6) AS nearby, count_if(share < 0.25) AS rejected FROM m GROUP BY query_id""")
def grd_coverage_bands(spark, sf_dir):
    prompts = table(spark, sf_dir, "prompt_records").select(F.expr("cast(substr(prompt_id, 2) as bigint)").alias("query_id"), F.col("prompt_text").alias("text")).distinct()
    return D.coverage_bands(prompts, docs(spark, sf_dir))


@query("""WITH p AS (SELECT DISTINCT prompt_id, prompt_text AS t FROM prompt_records) SELECT prompt_id, CASE WHEN regexp_matches(t, '(?i)recommend|citations? for|empfiehl|recommande|recomienda') THEN 'recommendation' WHEN regexp_matches(t, '(?i)uploaded|hochgeladen|déposé|subido|peer review|Gutachten') THEN 'direct' ELSE 'retrieval' END AS route,
  coalesce(nullif(regexp_extract(t, '(?i)(?:paragraph about|paper on|work on|say about) (.+?)[.?!]*$', 1), ''), '-') AS topic FROM p""")
def rte_route_and_topic(spark, sf_dir):
    return D.route(table(spark, sf_dir, "prompt_records").select("prompt_id", "prompt_text").distinct())


PARSED = "pp AS (SELECT * FROM parsed_papers WHERE parsed_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY parsed_id ORDER BY parsed_at DESC NULLS LAST) = 1)"


@query(f"""WITH {PARSED}, s AS (SELECT parsed_id, unnest(map_entries(sections)) AS e FROM pp) SELECT parsed_id, e.key AS part, length(e.value) AS chars FROM s WHERE trim(coalesce(e.value, ''), E' ') <> ''""")
def doc_section_texts(spark, sf_dir):
    return D.section_rows(D.current(table(spark, sf_dir, "parsed_papers"))).select("parsed_id", "part", F.length("text").cast("bigint").alias("chars"))


RULES = """list_filter([CASE WHEN length(coalesce(sections['abstract'], '')) < 200 THEN 'short abstract' END, CASE WHEN length(coalesce(sections['method'], '')) < 400 THEN 'short method' END, CASE WHEN length(coalesce(sections['results'], '')) < 300 THEN 'short results' END,
  CASE WHEN length(coalesce(sections['conclusion'], '')) < 150 THEN 'short conclusion' END, CASE WHEN coalesce(len(reference_entries), 0) < 10 THEN 'few references' END, CASE WHEN NOT regexp_matches(lower(array_to_string(map_values(sections), chr(10))), '\\b(?:accuracy|precision|recall|f1(?:-score)?|bleu|rouge(?:-[12l])?|perplexity|mrr|map|ndcg(?:@[0-9]+)?|auc|exact match|treesim|episode return|sample efficiency|wall-clock time)\\b') THEN 'no metric' END,
  CASE WHEN length(coalesce(sections['limitations'], '')) = 0 THEN 'no limitations' END, CASE WHEN length(coalesce(sections['related_work'], '')) = 0 THEN 'no related work' END], lambda x: x IS NOT NULL)"""


@query(f"WITH {PARSED} SELECT parsed_id, unnest({RULES}) AS finding FROM pp")
def doc_structural_checks(spark, sf_dir):
    return D.structural_checks(D.current(table(spark, sf_dir, "parsed_papers")))


ENT = " UNION ALL ".join(f"SELECT parsed_id, '{k}' AS kind, unnest(entities.{k}) AS entity FROM pp" for k in D.ENTITY_KINDS)


@query(f"WITH {PARSED}, e AS ({ENT}) SELECT kind, entity, count(DISTINCT parsed_id) AS papers FROM e WHERE entity IS NOT NULL GROUP BY 1, 2")
def nlp_entity_counts(spark, sf_dir):
    return D.entity_rows(D.current(table(spark, sf_dir, "parsed_papers"))).groupBy("kind", "entity").agg(F.count_distinct("parsed_id").alias("papers"))


@query(f"""WITH {DOCS}, m AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '(\\b(?:accuracy|precision|recall|f1(?:-score)?|bleu|rouge(?:-[12l])?|perplexity|mrr|map|ndcg(?:@[0-9]+)?|auc|exact match|treesim|episode return|sample efficiency|wall-clock time)\\b)')) AS metric FROM d) SELECT metric, count(*) AS mentions, count(DISTINCT doc_id) AS docs FROM m GROUP BY metric""")
def nlp_gazetteer_metrics(spark, sf_dir):
    pattern = f"({D.METRIC_WORDS})"
    m = docs(spark, sf_dir).select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(pattern), 1)).alias("metric"))
    return m.groupBy("metric").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"))


@query()
def nlp_extractive_summary(spark, sf_dir):
    return D.extractive_summary(D.section_texts(D.current(table(spark, sf_dir, "parsed_papers"))), 5)


@query(f"""WITH {PARSED}, r AS (SELECT parsed_id, unnest(reference_entries) AS entry FROM pp), k AS (SELECT parsed_id, entry, trim(regexp_replace(lower(entry), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS k FROM r WHERE length(entry) >= 20 AND regexp_matches(entry, '\\p{{L}}'))
SELECT parsed_id, count(DISTINCT k) AS references_kept, count(*) - count(DISTINCT k) AS repeated FROM k GROUP BY parsed_id""")
def doc_reference_dedup(spark, sf_dir):
    return D.reference_counts(D.current(table(spark, sf_dir, "parsed_papers")))


@query(f"""WITH {GEN}, x AS (SELECT generation_id, CASE WHEN text IS NULL THEN 'none' WHEN regexp_matches(text, '^\\s*(```\\w*\\s*)?[{{\\[]') THEN CASE WHEN json_valid(trim(regexp_replace(regexp_replace(text, '^\\s*```\\w*\\s*', ''), '```\\s*$', ''), E' ')) THEN 'json' ELSE 'broken json' END
  WHEN regexp_matches(text, '(?m)^#{{1,6}} ') THEN 'markdown' WHEN regexp_matches(text, '(?m)^\\s*([-*•]|\\d+[.)])\\s') THEN 'list' ELSE 'prose' END AS form FROM g) SELECT form, count(*) AS outputs FROM x GROUP BY form""")
def grd_output_forms(spark, sf_dir):
    return generations(spark, sf_dir).groupBy(D.output_form(F.col("text")).alias("form")).agg(F.count("*").alias("outputs"))


@query("""WITH g AS (SELECT DISTINCT generation_id, task, model, strategy, latency_seconds, error FROM model_generations), c AS (SELECT coalesce(task, '-') AS task, strategy, count(*) AS n, CAST(sum(CAST(latency_seconds AS DECIMAL(18, 6))) AS DOUBLE) AS latency_sum, count(latency_seconds) AS timed, count(error) AS errors FROM g GROUP BY 1, 2) SELECT task, strategy, n, round(latency_sum / timed, 4) AS latency, errors FROM c""")
def grd_strategy_grid(spark, sf_dir):
    g = table(spark, sf_dir, "model_generations").select("generation_id", "task", "model", "strategy", "latency_seconds", "error").distinct()
    return g.groupBy(F.coalesce("task", F.lit("-")).alias("task"), "strategy").agg(F.count("*").alias("n"), F.round(F.sum(F.col("latency_seconds").cast("decimal(18,6)")).cast("double") / F.count("latency_seconds"), 4).alias("latency"), F.count("error").alias("errors"))


@query("""WITH g AS (SELECT DISTINCT generation_id, prompt_id, task, text FROM model_generations WHERE text IS NOT NULL AND trim(text, E' ') <> '') SELECT g.generation_id, p.task || '|' || p.style AS tag, 3 AS messages, length(p.prompt_text) AS user_chars, length(g.text) AS assistant_chars FROM g JOIN (SELECT DISTINCT * FROM prompt_records) p USING (prompt_id)""")
def trn_chat_rows(spark, sf_dir):
    rows = D.chat_rows(table(spark, sf_dir, "model_generations"), table(spark, sf_dir, "prompt_records"))
    return rows.select("generation_id", F.concat_ws("|", "task", "style").alias("tag"), F.size("messages").alias("messages"), F.length(F.col("messages")[1]["content"]).cast("bigint").alias("user_chars"), F.length(F.col("messages")[2]["content"]).cast("bigint").alias("assistant_chars"))
