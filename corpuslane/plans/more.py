"""Evidence packs, promoted rankings, citation links, query sampling, headings and message checks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslane.functions import python as Y
from corpuslane.functions import text as X
from corpuslane.operators import records as R
from corpuslane.operators import retrieval as T
from corpuslane.plans import search
from corpuslane.plans.corpus import LATEST, papers
from corpuslane.plans.documents import DOCS, GEN, docs, generations
from corpuslane.runtime import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""WITH {search.INDEX}, {search.QPROMPT}, {search.OKAPI}, top AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM bm WHERE rank <= 5), t AS (SELECT top.*, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS x FROM top JOIN d USING (doc_id))
SELECT query_id, 'S' || rank AS source_id, doc_id, round_even(least(0.99, 0.55 + CASE WHEN best = 0 THEN 0 ELSE score / best END * 0.44), 2) AS score, CASE WHEN length(x) > 420 THEN concat(rtrim(substr(x, 1, 420)), '...') ELSE x END AS snippet FROM t""")
def ret_evidence_pack(spark, sf_dir):
    ranked = T.bm25(search._index(spark, sf_dir), search._prompts(spark, sf_dir), 5)
    return T.evidence_pack(ranked, docs(spark, sf_dir), 420, 5)


@query(f"""WITH {search.INDEX}, {search.QPROMPT}, {search.TFIDF}, c AS (SELECT query_id, doc_id, score FROM tfidf), r AS (SELECT c.*, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(contains(lower(text), 'distribution shift'), false) DESC, score DESC, doc_id) AS rank FROM c JOIN d USING (doc_id))
SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def ret_promote_whole(spark, sf_dir):
    """Documents with the phrase before all others, over every matching document."""
    found = T.tfidf(search._index(spark, sf_dir), search._prompts(spark, sf_dir), None).join(docs(spark, sf_dir), "doc_id")
    return T.promote(found, F.contains(F.lower("text"), F.lit("distribution shift")), 10).select("query_id", "doc_id", "score", "rank")


# The plain name promotes over every matching document as well.
QUERIES["ret_promote"], ORACLE["ret_promote"] = QUERIES["ret_promote_whole"], ORACLE["ret_promote_whole"]


@query(f"""WITH {LATEST}, e AS (SELECT DISTINCT paper_id AS a, unnest(reference_ids) AS b FROM latest), seeds AS (SELECT paper_id FROM latest WHERE citation_count >= 50),
l AS (SELECT a AS candidate, b AS seed, 'cites' AS link FROM e WHERE b IN (SELECT paper_id FROM seeds) UNION ALL SELECT b, a, 'cited_by' FROM e WHERE a IN (SELECT paper_id FROM seeds))
SELECT candidate, count(DISTINCT seed) AS seeds, string_agg(DISTINCT link, ',' ORDER BY link) AS links FROM l WHERE candidate IS NOT NULL AND candidate <> seed GROUP BY candidate""")
def jn_seed_citation_links(spark, sf_dir):
    p = papers(spark, sf_dir)
    seeds = p.where("citation_count >= 50").select(F.col("paper_id").alias("seed"))
    e = p.select(F.col("paper_id").alias("a"), F.explode("reference_ids").alias("b")).distinct()
    out = e.join(seeds, e.b == seeds.seed).select(F.col("a").alias("candidate"), "seed", F.lit("cites").alias("link"))
    back = e.join(seeds, e.a == seeds.seed).select(F.col("b").alias("candidate"), "seed", F.lit("cited_by").alias("link"))
    both = out.unionByName(back).where("candidate is not null and candidate <> seed")
    return both.groupBy("candidate").agg(F.count_distinct("seed").alias("seeds"), F.array_join(F.array_sort(F.collect_set("link")), ",").alias("links"))


@query(f"""WITH {LATEST}, c AS (SELECT trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS q FROM latest UNION ALL SELECT array_to_string(w[:12], ' ') FROM (SELECT regexp_extract_all(coalesce(abstract, ''), '[^ \\t\\n\\x0b\\f\\r]+') AS w FROM latest) WHERE len(w) >= 8),
k AS (SELECT lower(q) AS key, min(q) AS query FROM c WHERE q <> '' GROUP BY 1) SELECT query FROM k ORDER BY sha256('42:' || key), key LIMIT 200""")
def trn_query_sampling(spark, sf_dir):
    p = papers(spark, sf_dir)
    titles = p.select(X.clean_text(F.col("title")).alias("q"))
    words = p.select(F.regexp_extract_all(F.coalesce("abstract", F.lit("")), F.lit(r"([^ \t\n\x0B\f\r]+)"), 1).alias("w")).where(F.size("w") >= 8).select(F.array_join(F.slice("w", 1, 12), " ").alias("q"))
    k = titles.unionByName(words).where("q <> ''").groupBy(F.lower("q").alias("key")).agg(F.min("q").alias("query"))
    return k.orderBy(R.hash_order("42", "key"), "key").limit(200).select("query")


@query(f"""WITH {GEN}, l AS (SELECT generation_id, unnest(string_split(text, E'\\n')) AS line, generate_subscripts(string_split(text, E'\\n'), 1) AS i, len(string_split(text, E'\\n')) AS n FROM g WHERE text IS NOT NULL),
h AS (SELECT generation_id, i, n, regexp_extract(line, '^(#{{1,6}}|\\*\\*)\\s*(.+?)\\**\\s*$', 2) AS heading FROM l WHERE regexp_matches(line, '^(#{{1,6}} .+|\\*\\*[^*]+\\*\\*\\s*)$'))
SELECT generation_id, i AS line_no, lower(regexp_replace(heading, '^[ .:\\-]+|[ .:\\-]+$', '', 'g')) AS heading, coalesce(lead(i) OVER (PARTITION BY generation_id ORDER BY i), n + 1) - i - 1 AS body_lines FROM h""")
def doc_headings(spark, sf_dir):
    lines = F.split("text", "\n")
    l = generations(spark, sf_dir).where("text is not null").select("generation_id", F.posexplode(lines).alias("p", "line"), F.size(lines).alias("n")).where(F.col("line").rlike(r"^(#{1,6} .+|\*\*[^*]+\*\*\s*)$"))  # noqa: E741
    heading = F.regexp_extract("line", r"^(#{1,6}|\*\*)\s*(.+?)\**\s*$", 2)
    after = F.lead("line_no").over(Window.partitionBy("generation_id").orderBy("line_no"))
    return l.withColumn("line_no", (F.col("p") + 1).cast("bigint")).select("generation_id", "line_no", F.lower(F.regexp_replace(heading, r"^[ .:\-]+|[ .:\-]+$", "")).alias("heading"), (F.coalesce(after, F.col("n") + 1) - F.col("line_no") - 1).alias("body_lines"))


@query(f"""WITH {DOCS}, x AS (SELECT d.doc_id, CASE WHEN length(coalesce(text, '')) < 35 THEN 'short' WHEN length(text) <= 800 THEN 'kept' ELSE 'long' END AS band FROM d) SELECT band, count(*) AS docs FROM x GROUP BY band""")
def flt_length_band(spark, sf_dir):
    n = F.length(F.coalesce("text", F.lit("")))
    return docs(spark, sf_dir).groupBy(F.when(n < 35, "short").when(n <= 800, "kept").otherwise("long").alias("band")).agg(F.count("*").alias("docs"))


@query("""WITH g AS (SELECT DISTINCT generation_id, prompt_id, model, strategy, latency_seconds AS s FROM model_generations), p AS (SELECT DISTINCT prompt_id, task FROM prompt_records), m AS (SELECT p.task, strategy, avg(s) AS mean FROM g JOIN p USING (prompt_id) GROUP BY 1, 2)
SELECT task, round(max(CASE WHEN strategy = (SELECT min(strategy) FROM g) THEN mean END), 6) AS first_mean, round(max(CASE WHEN strategy = (SELECT max(strategy) FROM g) THEN mean END), 6) AS last_mean FROM m GROUP BY task""")
def evl_strategy_pivot(spark, sf_dir):
    g = table(spark, sf_dir, "model_generations").select("generation_id", "prompt_id", "model", "strategy", F.col("latency_seconds").alias("s")).distinct()
    ends = g.agg(F.min("strategy").alias("lo"), F.max("strategy").alias("hi"))
    m = g.join(table(spark, sf_dir, "prompt_records").select("prompt_id", "task").distinct(), "prompt_id").groupBy("task", "strategy").agg(F.avg("s").alias("mean")).crossJoin(F.broadcast(ends))  # one row
    return m.groupBy("task").agg(F.round(F.max(F.when(F.col("strategy") == F.col("lo"), F.col("mean"))), 6).alias("first_mean"), F.round(F.max(F.when(F.col("strategy") == F.col("hi"), F.col("mean"))), 6).alias("last_mean"))


@query()
def txt_first_json_object(spark, sf_dir):
    g = generations(spark, sf_dir).where(F.contains("text", F.lit("{")))
    return g.select("generation_id", Y.first_json_object("text").alias("object")).select("generation_id", F.length("object").alias("chars"), F.try_parse_json("object").isNotNull().alias("valid"))


@query()
def txt_title_similarity(spark, sf_dir):
    """How alike the titles of a parsed paper and of its record are."""
    parsed = table(spark, sf_dir, "parsed_papers").where("paper_id is not null and title is not null").select("parsed_id", "paper_id", F.col("title").alias("parsed_title")).distinct()
    both = parsed.join(papers(spark, sf_dir).select("paper_id", "title"), "paper_id").where("title is not null")
    return both.select("parsed_id", F.round(Y.sequence_ratio("parsed_title", "title"), 6).alias("similarity"))
