"""Markdown sections and parsed answers, training rows, weight trade-offs and section-weighted search, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuslane.operators import documents as D
from corpuslane.operators import evaluation as E
from corpuslane.operators import markdown as M
from corpuslane.operators import retrieval as T
from corpuslane.operators import training as N
from corpuslane.plans import search
from corpuslane.plans.documents import GEN, PARSED, docs, generations
from corpuslane.runtime import cut_lineage, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SECTIONS = f"WITH {GEN}" + r""", ls AS (SELECT generation_id, string_split(regexp_replace(text, '\r\n?', E'\n', 'g'), E'\n') AS ls FROM g WHERE text IS NOT NULL),
l AS (SELECT generation_id, regexp_replace(unnest(ls), '^\s+|\s+$', '', 'g') AS t, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM ls),
h AS (SELECT *, CASE WHEN regexp_matches(t, '^#{1,6}\s+\S') THEN length(regexp_extract(t, '^(#{1,6})', 1)) WHEN regexp_matches(t, '^\*\*(.+)\*\*\s*:?$') THEN 2 END AS level FROM l),
s AS (SELECT h.generation_id, h.i, h.level, h.n, lower(regexp_replace(regexp_replace(regexp_replace(h.t, '^#{1,6}\s+|\s*#*$', '', 'g'), '[*_`]', '', 'g'), '^\s+|[\s:]+$', '', 'g')) AS title, min(o.i) AS stop FROM h LEFT JOIN h o ON o.generation_id = h.generation_id AND o.i > h.i AND o.level <= h.level WHERE h.level IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
b AS (SELECT generation_id, i, trim(regexp_replace(regexp_replace(t, '^[-* ]+', ''), '\s+', ' ', 'g')) AS item FROM l WHERE regexp_matches(t, '^[-*]') AND length(t) > 2)
SELECT s.generation_id, s.i AS line_no, level, title, coalesce(stop, n + 1) - s.i - 1 AS body_lines, count(b.item) AS items, arg_min(b.item, b.i) AS first_item FROM s LEFT JOIN b ON b.generation_id = s.generation_id AND b.i > s.i AND b.i < coalesce(stop, n + 1) GROUP BY ALL"""


@query(SECTIONS)
def doc_markdown_sections(spark, sf_dir):
    b = M.bullets(F.col("body"))
    s = M.sections(generations(spark, sf_dir).where("text is not null"), "generation_id")
    return s.select("generation_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("level").cast("bigint").alias("level"), "title", F.size("body").cast("bigint").alias("body_lines"), F.size(b).cast("bigint").alias("items"), F.get(b, F.lit(0)).alias("first_item"))


@query()
def grd_parse_answers(spark, sf_dir):
    """Summary, findings and gaps of every answer, from its JSON or else its Markdown."""
    g = table(spark, sf_dir, "model_generations").select("generation_id", "text", "error").distinct()
    return M.parse_answers(g, "generation_id")


GRID = [(1.2, 0.4), (1.2, 0.75), (1.5, 0.4), (1.5, 0.75)]
GRID_SQL = ", ".join(f"({k1}::DOUBLE, {b}::DOUBLE)" for k1, b in GRID)


@query(f"""WITH {search.INDEX}, {search.QPROMPT}, {search.OKAPI}, grid(k1, b) AS (VALUES {GRID_SQL}),
sc AS (SELECT k1, b, q.query_id, p.doc_id, round(sum(qtf * CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))), 9) AS score FROM q JOIN idf USING (term) CROSS JOIN mi JOIN p USING (term) JOIN l USING (doc_id) CROSS JOIN s CROSS JOIN grid GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0) SELECT k1, b, query_id, doc_id, score, rank FROM r WHERE rank <= 5""")
def ret_bm25_grid(spark, sf_dir):
    return T.bm25_grid(search._index(spark, sf_dir), search._prompts(spark, sf_dir), 5, GRID)


ROLES = {"whole": 0.4, "method": 0.3, "results": 0.2, "background": 0.1}


@query("""WITH v AS (SELECT vec_id // 4 AS doc_id, CASE vec_id % 4 WHEN 0 THEN 0.4 WHEN 1 THEN 0.3 WHEN 2 THEN 0.2 ELSE 0.1 END::DOUBLE AS w, embedding FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.doc_id, round(sum(w * list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))), 9) AS score FROM embeddings q JOIN v ON q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) SELECT query_id, doc_id, score, rank FROM r WHERE rank <= 10""")
def ret_section_weighted(spark, sf_dir):
    """Four neighbouring vectors stand for the whole, the method, the results and the background of one document."""
    e = table(spark, sf_dir, "embeddings")
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.col("vec_id") % 4 + 1).cast("int"))
    one = T.role_weighted(e.select(F.expr("vec_id div 4").alias("doc_id"), role.alias("role"), F.col("embedding").alias("vec")), ROLES)
    return T.nearest(one, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), 10)


@query(f"""WITH {search.LISTS.replace('lists AS', 'two AS')}, grid AS (SELECT w / 20.0 AS weight FROM range(0, 21) t(w)), m0 AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM two WINDOW w AS (PARTITION BY query_id, component)),
nrm AS (SELECT query_id, doc_id, component, CASE WHEN hi - lo < 1e-9 THEN 0.5 ELSE (score - lo) / (hi - lo) END AS x FROM m0), f AS (SELECT weight, query_id, doc_id, round(sum(CASE component WHEN 'bm25' THEN weight ELSE 1 - weight END * x), 9) AS score FROM nrm CROSS JOIN grid GROUP BY 1, 2, 3),
lists AS (SELECT weight AS component, query_id, doc_id, score, row_number() OVER (PARTITION BY weight, query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10), {search.GOLD}, {search.METRIC_SQL},
a AS (SELECT round(component, 2) AS weight, avg(ap) FILTER (query_id % 100 = 0) AS map_a, avg(ndcg_standard) FILTER (query_id % 100 = 0) AS ndcg_a, avg(ap) FILTER (query_id % 100 <> 0) AS map_b, avg(ndcg_standard) FILTER (query_id % 100 <> 0) AS ndcg_b FROM m GROUP BY 1),
z AS (SELECT map_a AS ma, ndcg_a AS na, map_b AS mb, ndcg_b AS nb FROM a WHERE weight = 0.55)
SELECT weight, round(map_a, 6) AS map_a, round(ndcg_a, 6) AS ndcg_a, round(map_b, 6) AS map_b, round(ndcg_b, 6) AS ndcg_b, map_a >= ma - 1e-9 AND ndcg_a >= na - 1e-9 AND map_b >= mb - 1e-9 AND ndcg_b >= nb - 1e-9 AS balanced, map_a >= ma * 0.98 - 1e-9 AND ndcg_a >= na * 0.98 - 1e-9 AS relaxed FROM a CROSS JOIN z""")
def evl_weight_tradeoff(spark, sf_dir):
    """Which fusion weights are no worse than 0.55 on two query sets, or at most 2 % worse on the first."""
    return _tradeoff(spark, sf_dir, search._may_lead(spark, sf_dir, 10))


# The name from before the plain one ranked whole lists.
QUERIES["evl_weight_tradeoff_whole"], ORACLE["evl_weight_tradeoff_whole"] = QUERIES["evl_weight_tradeoff"], ORACLE["evl_weight_tradeoff"]


def _tradeoff(spark, sf_dir, two):
    grid = spark.range(21).select((F.col("id") / 20.0).alias("weight"))
    scored = two.crossJoin(F.broadcast(grid)).withColumn("score", F.round(F.col("weight") * F.col("b") + (1 - F.col("weight")) * F.col("t"), 9))  # 21 weights
    rank = F.row_number().over(Window.partitionBy("weight", "query_id").orderBy(F.desc("score"), "doc_id"))
    per = E.ranking_metrics(cut_lineage(scored.withColumn("rank", rank).where("rank <= 10")), search._gold(spark, sf_dir), 5, ("weight",))
    return E.tradeoff(per.withColumn("part", F.when(F.col("query_id") % 100 == 0, "a").otherwise("b")).withColumn("weight", F.round("weight", 2)), "weight", 0.55)


PACK = f"""WITH {search.INDEX}, {search.QPROMPT}, {search.OKAPI}, top AS (SELECT query_id, doc_id, rank, 'S' || rank AS sid FROM bm WHERE rank <= 5), x AS (SELECT query_id, rank, sid, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM top JOIN d USING (doc_id)),
sn AS (SELECT query_id, rank, sid, CASE WHEN length(t) > 420 THEN concat(rtrim(substr(t, 1, 420)), '...') ELSE t END AS snippet FROM x), tasks(task, opening, most, quoted) AS (VALUES {', '.join(f"('{t}', '{o}', {m}, {q})" for t, (o, m, q) in N.PACK_TASKS.items())}),
made AS (SELECT query_id, task, opening || E'\\n' || string_agg('- ' || CASE WHEN quoted THEN snippet ELSE 'see' END || ' [' || sid || ']', E'\\n' ORDER BY rank) AS text FROM sn JOIN tasks ON rank <= most GROUP BY query_id, task, opening),
av AS (SELECT query_id, list(sid) AS available FROM sn GROUP BY 1), qt AS (SELECT DISTINCT CAST(substr(prompt_id, 2) AS BIGINT) AS query_id, prompt_text AS user_text FROM prompt_records)"""
IDS = """list_sort(list_distinct(list_concat(regexp_extract_all(text, '\\d{4}\\.\\d{4,5}'), list_filter(flatten(list_transform(regexp_extract_all(text, '\\[([^\\[\\]]+)\\]', 1), lambda t: list_transform(regexp_split_to_array(t, '[,;]'), lambda x: trim(x)))), lambda x: regexp_full_match(x, 'S\\d+|\\d{4}\\.\\d{4,5}(v\\d+)?')))))"""
KEPT = f"""ids AS (SELECT made.*, available, user_text, {IDS} AS used FROM made JOIN av USING (query_id) JOIN qt USING (query_id)), kept AS (SELECT * FROM ids WHERE len(used) > 0 AND len(list_filter(used, lambda u: NOT list_contains(available, u))) = 0 AND trim(user_text) <> '')"""


def _instructions(spark, sf_dir):
    prompts = search._prompts(spark, sf_dir)
    ranked = T.bm25(search._index(spark, sf_dir), prompts, 5)
    return N.instruction_rows(T.evidence_pack(ranked, docs(spark, sf_dir), 420, 5), prompts)


@query(f"{PACK}, {KEPT} SELECT task, CAST(query_id AS VARCHAR) AS key, length(text) AS chars, sha256(text) AS sha FROM kept")
def trn_instruction_rows(spark, sf_dir):
    return _instructions(spark, sf_dir).select("task", "key", F.length("assistant").cast("bigint").alias("chars"), F.sha2("assistant", 256).alias("sha"))


PAPER = "pr AS (" + " UNION ALL ".join(f"SELECT parsed_id, '{t}' AS task, sections['{a}'] AS u, sections['{b}'] AS s FROM pp" for t, (a, b) in N.PAPER_TASKS.items()) + "), pk AS (SELECT * FROM pr WHERE trim(coalesce(u, ''), E' ') <> '' AND trim(coalesce(s, ''), E' ') <> '' QUALIFY row_number() OVER (PARTITION BY task ORDER BY parsed_id) <= 100)"


def _papers(spark, sf_dir):
    return N.paper_rows(D.current(table(spark, sf_dir, "parsed_papers")), 100)


@query(f"WITH {PARSED}, {PAPER}, w AS (SELECT unnest([{', '.join(repr(t) for t in N.PAPER_TASKS)}]) AS task), c AS (SELECT task, count(*) AS n FROM pk GROUP BY 1) SELECT task, 100 AS wanted, coalesce(n, 0) AS rows, greatest(100 - coalesce(n, 0), 0) AS deficit FROM w LEFT JOIN c USING (task)")
def trn_paper_deficits(spark, sf_dir):
    return N.deficits(_papers(spark, sf_dir), dict.fromkeys(N.PAPER_TASKS, 100))


CHAT = f"""{PARSED}, {PAPER}, gn AS (SELECT DISTINCT generation_id, prompt_id, text FROM model_generations WHERE trim(coalesce(text, ''), E' ') <> ''), ch AS (SELECT p.task, p.prompt_text AS u, gn.text AS s FROM gn JOIN (SELECT DISTINCT * FROM prompt_records) p USING (prompt_id)),
al AS (SELECT 'papers' AS source, task, u, s FROM pk UNION ALL SELECT 'packs', task, user_text, text FROM kept UNION ALL SELECT 'answers', task, u, s FROM ch)"""


def _merged(spark, sf_dir):
    m = D.chat_rows(table(spark, sf_dir, "model_generations"), table(spark, sf_dir, "prompt_records"))
    answers = m.select(F.lit("answers").alias("source"), "task", F.col("generation_id").cast("string").alias("key"), F.col("messages")[1]["content"].alias("user"), F.col("messages")[2]["content"].alias("assistant"))
    return _papers(spark, sf_dir).unionByName(_instructions(spark, sf_dir)).unionByName(answers)


@query(f"{PACK}, {KEPT}, {CHAT} SELECT source, task, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(u || '|' || s), 1, 8) AS BIGINT)) AS BIGINT) AS checksum FROM al GROUP BY 1, 2")
def trn_merge_manifest(spark, sf_dir):
    return N.manifest(_merged(spark, sf_dir))


@query(f"{PACK}, {KEPT}, {CHAT} SELECT task, count(*) AS rows, round(avg(length(s)), 4) AS mean_chars, quantile_disc(length(s), 0.5) AS p50, quantile_disc(length(s), 0.95) AS p95, count_if(regexp_matches(s, '\\[S\\d+\\]')) AS cited FROM al GROUP BY 1")
def trn_statistics(spark, sf_dir):
    return N.statistics(_merged(spark, sf_dir))


@query("""WITH e AS (SELECT DISTINCT event_id, user_id, ts, event_type, json_extract_string(props, '$.k') AS k FROM events WHERE event_type IN ('signup', 'purchase', 'error')) SELECT user_id, event_id, ts, CASE event_type WHEN 'signup' THEN 'opened' WHEN 'purchase' THEN 'message' ELSE 'failure' END AS turn, k FROM e WHERE k IS NOT NULL""")
def str_transcript(spark, sf_dir):
    """The turns of each user's log, without rows whose payload is malformed."""
    turns = F.create_map(*[F.lit(x) for x in ("signup", "opened", "purchase", "message", "error", "failure")])
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "purchase", "error"))
    rows = e.select("user_id", "event_id", "ts", F.element_at(turns, F.col("event_type")).alias("turn"), F.get_json_object("props", "$.k").alias("k"))
    return rows.where("k is not null").distinct()
