"""Queries over paper records: cleaning, validation, exploration, sampling, joins and sets, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslane.functions import scalars as S
from corpuslane.functions import text as X
from corpuslane.operators import records as R
from corpuslane.runtime import table

QUERIES, ORACLE = {}, {}
TARGETS = ["cs.LG", "cs.CL", "cs.CV", "cs.AI", "stat.ML"]

LATEST = """latest AS (SELECT * FROM paper_records WHERE paper_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY loaded_at DESC NULLS LAST, coalesce(citation_count, -1) DESC, coalesce(influential_citation_count, -1) DESC) = 1)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.latest(table(spark, sf_dir, "paper_records"))


@query(f"WITH {LATEST} SELECT paper_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS title, length(trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g'))) AS abstract_chars FROM latest")
def prj_clean_text(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.select("paper_id", X.clean_text(F.col("title")).alias("title"), F.length(X.clean_text(F.col("abstract"))).cast("bigint").alias("abstract_chars"))


@query(f"""WITH {LATEST} SELECT paper_id, trim(regexp_replace(coalesce(title, ''), '\\s+', ' ', 'g')) AS title, trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g')) AS abstract,
  array_to_string(list_filter(authors, lambda x: x IS NOT NULL), ', ') AS authors, array_to_string(list_filter(categories, lambda x: x IS NOT NULL), ' ') AS categories, coalesce(published_date, '') AS update_date FROM latest""")
def prj_flat_record(spark, sf_dir):
    return R.to_flat(papers(spark, sf_dir))


@query(f"""WITH {LATEST} SELECT paper_id, len(regexp_extract_all(coalesce(title, ''), '\\S+')) AS title_words, len(regexp_extract_all(coalesce(abstract, ''), '\\S+')) AS abstract_words,
  coalesce(len(authors), 0) AS n_authors, coalesce(len(categories), 0) AS n_categories, coalesce(CAST(nullif(regexp_extract(published_date, '^(\\d{{4}})', 1), '') AS INT), 0) AS year,
  coalesce(CAST(nullif(regexp_extract(published_date, '^\\d{{4}}-(\\d{{2}})', 1), '') AS INT), 0) AS month, CAST(trim(coalesce(doi, '')) <> '' AS INT) AS has_doi, CAST(trim(coalesce(venue, '')) <> '' AS INT) AS has_venue,
  CAST(trim(coalesce(tldr, '')) <> '' AS INT) AS has_tldr, coalesce(len(reference_ids), 0) AS ref_count FROM latest""")
def prj_eda_columns(spark, sf_dir):
    return R.derived(papers(spark, sf_dir)).na.fill(0, ["year", "month"])


@query(f"""WITH {LATEST}, t AS (SELECT paper_id, trim(regexp_replace(coalesce(abstract, ''), '\\s+', ' ', 'g')) AS a FROM latest)
SELECT paper_id, CASE WHEN length(a) > 120 THEN concat(rtrim(substr(a, 1, 117)), '...') ELSE a END AS short, CASE WHEN length(a) > 300 THEN concat(rtrim(substr(a, 1, 300)), '...') ELSE a END AS snippet FROM t""")
def prj_truncate_snippet(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.select("paper_id", X.truncate(F.col("abstract"), 120).alias("short"), X.snippet(X.clean_text(F.col("abstract")), 300).alias("snippet"))


@query(f"""WITH {LATEST}, t AS (SELECT paper_id, list_transform(categories, lambda x: lower(trim(x))) AS c FROM latest)
SELECT paper_id, coalesce(nullif(c[1], ''), '-') AS first_category, coalesce(list_filter(c, lambda x: x IN ('cs.lg','cs.cl','cs.cv','cs.ai','stat.ml'))[1], '-') AS by_position,
  coalesce(list_filter(['cs.lg','cs.cl','cs.cv','cs.ai','stat.ml'], lambda x: list_contains(c, x))[1], '-') AS by_priority FROM t""")
def prj_primary_category(spark, sf_dir):
    p, none = papers(spark, sf_dir), F.lit("-")
    return p.select("paper_id", F.coalesce(R.first_category(F.col("categories")), none).alias("first_category"), F.coalesce(R.primary_by_position(F.col("categories"), TARGETS), none).alias("by_position"), F.coalesce(R.primary_by_priority(F.col("categories"), TARGETS), none).alias("by_priority"))


@query(f"""WITH {LATEST}, t AS (SELECT *, lower(coalesce(title, '')) AS l FROM latest) SELECT paper_id, regexp_replace(regexp_replace(l, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || left(sha256(coalesce(title, '')), 10) AS stable_id,
  regexp_replace(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS safe_name, coalesce(nullif(regexp_extract(arxiv_id, '(\\d{{4}}\\.\\d{{4,5}})(v\\d+)?', 1), ''), '-') AS arxiv FROM t""")
def txt_ids(spark, sf_dir):
    title = F.coalesce("title", F.lit(""))
    return papers(spark, sf_dir).select("paper_id", S.stable_id(title).alias("stable_id"), X.safe_name(title).alias("safe_name"), F.coalesce(X.arxiv_id(F.col("arxiv_id")), F.lit("-")).alias("arxiv"))


@query(f"""WITH {LATEST}, f AS (SELECT paper_id, list_filter([
  CASE WHEN trim(coalesce(title, '')) = '' THEN 'missing title' END, CASE WHEN trim(coalesce(abstract, '')) = '' THEN 'missing abstract' END, CASE WHEN trim(coalesce(published_date, '')) = '' THEN 'missing published_date' END,
  CASE WHEN coalesce(len(authors), 0) = 0 THEN 'empty authors' END, CASE WHEN coalesce(len(categories), 0) = 0 THEN 'empty categories' END,
  CASE WHEN coalesce(source, '') NOT IN ('arxiv','semantic_scholar','openalex','acl','pubmed','kaggle') THEN 'unknown source' END, CASE WHEN coalesce(citation_count, 0) < 0 THEN 'negative count' END], lambda x: x IS NOT NULL) AS p FROM latest)
SELECT paper_id, unnest(p) AS problem FROM f""")
def flt_validate(spark, sf_dir):
    return R.problems(papers(spark, sf_dir))


@query(f"""WITH {LATEST} SELECT count(*) AS papers, count_if(trim(coalesce(title,'')) <> '' AND trim(coalesce(abstract,'')) <> '' AND trim(coalesce(published_date,'')) <> '' AND coalesce(len(authors),0) > 0 AND coalesce(len(categories),0) > 0) AS valid,
  count_if(trim(coalesce(doi,'')) = '') AS missing_doi, count_if(trim(coalesce(venue,'')) = '') AS missing_venue FROM latest""")
def flt_corpus_report(spark, sf_dir):
    p = papers(spark, sf_dir)
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return p.agg(F.count("*").alias("papers"), F.count_if(there("title") & there("abstract") & there("published_date") & some("authors") & some("categories")).alias("valid"), F.count_if(~there("doi")).alias("missing_doi"), F.count_if(~there("venue")).alias("missing_venue"))


@query(f"""WITH {LATEST} SELECT paper_id FROM latest WHERE trim(coalesce(title,'')) <> '' AND trim(coalesce(abstract,'')) <> '' AND trim(coalesce(published_date,'')) <> '' AND list_has_any(list_transform(categories, lambda x: lower(trim(x))), ['cs.lg','cs.cl','cs.cv','cs.ai','stat.ml'])""")
def flt_required_and_category(spark, sf_dir):
    p = papers(spark, sf_dir)
    there = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return p.where(there("title") & there("abstract") & there("published_date") & R.primary_by_priority(F.col("categories"), TARGETS).isNotNull()).select("paper_id")


@query(f"""WITH {LATEST}, r AS (SELECT paper_id, unnest(reference_ids) AS ref FROM latest) SELECT r.paper_id, r.ref FROM r WHERE r.ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM latest l WHERE l.paper_id = r.ref)""")
def flt_dangling_references(spark, sf_dir):
    p = papers(spark, sf_dir)
    refs = p.select("paper_id", F.explode("reference_ids").alias("ref")).where("ref is not null")
    return refs.join(p.select(F.col("paper_id").alias("ref")), "ref", "left_anti").select("paper_id", "ref")


AUDIT = " UNION ALL ".join(f"SELECT '{f}' AS field, count_if({'coalesce(len(' + f + '),0) > 0' if f in ('authors', 'categories') else 'trim(coalesce(' + f + chr(44) + chr(39) * 2 + ')) <> ' + chr(39) * 2}) AS present, count(*) AS n FROM latest" for f in R.FIELDS)


@query(f"WITH {LATEST}, a AS ({AUDIT}) SELECT field, present, n - present AS missing, round(CASE WHEN n = 0 THEN 0 ELSE (n - present) * 100.0 / n END, 4) AS pct_missing FROM a")
def agg_missing_audit(spark, sf_dir):
    return R.audit(papers(spark, sf_dir))


@query(f"WITH {LATEST} SELECT coalesce(source, '-') AS source, count(*) AS papers, round(avg(citation_count), 4) AS mean, round(median(citation_count), 4) AS median, round(stddev_samp(citation_count), 4) AS sd, min(citation_count) AS least, max(citation_count) AS most FROM latest GROUP BY 1")
def agg_group_stats(spark, sf_dir):
    p, c = papers(spark, sf_dir), F.col("citation_count")
    return p.groupBy(F.coalesce("source", F.lit("-")).alias("source")).agg(F.count("*").alias("papers"), F.round(F.avg(c), 4).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 4).alias("median"), F.round(F.stddev_samp(c), 4).alias("sd"), F.min(c).alias("least"), F.max(c).alias("most"))


@query(f"WITH {LATEST} SELECT count(citation_count) AS n, round(avg(citation_count), 4) AS mean, round(stddev_samp(citation_count), 4) AS sd, min(citation_count) AS least, quantile_cont(citation_count, 0.25) AS q1, quantile_cont(citation_count, 0.5) AS q2, quantile_cont(citation_count, 0.75) AS q3, max(citation_count) AS most FROM latest")
def agg_describe(spark, sf_dir):
    c = F.col("citation_count")
    q = lambda s: F.percentile(c, F.lit(s))
    return papers(spark, sf_dir).agg(F.count(c).alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("sd"), F.min(c).alias("least"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max(c).alias("most"))


@query("""WITH v AS (SELECT doc_kind, n_chars AS x FROM (SELECT DISTINCT doc_id, doc_kind, n_chars FROM documents) WHERE n_chars IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_kind ORDER BY x) - 1 AS i, count(*) OVER (PARTITION BY doc_kind) AS n FROM v)
SELECT doc_kind, max(CASE WHEN i = round_even((n - 1) * 0.25, 0) THEN x END) AS p25, max(CASE WHEN i = round_even((n - 1) * 0.5, 0) THEN x END) AS p50, max(CASE WHEN i = round_even((n - 1) * 0.95, 0) THEN x END) AS p95 FROM r GROUP BY doc_kind""")
def agg_nearest_percentile(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "doc_kind", "n_chars").distinct()
    return R.nearest_percentile(d, "n_chars", [0.25, 0.5, 0.95], ["doc_kind"])


@query("SELECT doc_kind, count_if(lang = 'en') AS en, count_if(lang = 'de') AS de, count_if(lang = 'fr') AS fr, count_if(lang = 'es') AS es, count_if(lang = 'ru') AS ru FROM documents GROUP BY doc_kind")
def agg_pivot_kind_lang(spark, sf_dir):
    langs = ["en", "de", "fr", "es", "ru"]
    return table(spark, sf_dir, "documents").groupBy("doc_kind").pivot("lang", langs).count().na.fill(0, langs)


@query("SELECT coalesce(doc_kind, 'all') AS doc_kind, coalesce(lang, 'all') AS lang, grouping_id(doc_kind, lang) AS level, count(*) AS n FROM (SELECT coalesce(doc_kind, '-') AS doc_kind, coalesce(lang, '-') AS lang FROM documents) GROUP BY ROLLUP (doc_kind, lang)")
def agg_rollup_kind_lang(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.coalesce("doc_kind", F.lit("-")).alias("doc_kind"), F.coalesce("lang", F.lit("-")).alias("lang"))
    r = d.rollup("doc_kind", "lang").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))
    return r.select(F.coalesce("doc_kind", F.lit("all")).alias("doc_kind"), F.coalesce("lang", F.lit("all")).alias("lang"), "level", "n")


@query(f"WITH {LATEST}, a AS (SELECT unnest(authors) AS author FROM latest) SELECT count(*) AS entries, count(DISTINCT author) AS authors FROM a WHERE author IS NOT NULL")
def agg_distinct_authors(spark, sf_dir):
    return papers(spark, sf_dir).select(F.explode("authors").alias("author")).where("author is not null").agg(F.count("*").alias("entries"), F.count_distinct("author").alias("authors"))


@query(f"WITH {LATEST}, a AS (SELECT unnest(authors) AS author FROM latest) SELECT author, count(*) AS papers FROM a WHERE author IS NOT NULL GROUP BY author ORDER BY papers DESC, author LIMIT 25")
def top_authors(spark, sf_dir):
    return papers(spark, sf_dir).select(F.explode("authors").alias("author")).where("author is not null").groupBy("author").agg(F.count("*").alias("papers")).orderBy(F.desc("papers"), "author").limit(25)


@query(f"""WITH {LATEST}, y AS (SELECT CAST(nullif(regexp_extract(published_date, '^(\\d{{4}})', 1), '') AS INT) AS year FROM latest) SELECT year, count(*) AS papers, sum(count(*)) OVER (ORDER BY year) AS upto FROM y WHERE year IS NOT NULL GROUP BY year""")
def win_cumulative_growth(spark, sf_dir):
    y = papers(spark, sf_dir).select(S.year_of(F.col("published_date")).alias("year")).where("year is not null").groupBy("year").agg(F.count("*").alias("papers"))
    return y.withColumn("upto", F.sum("papers").over(Window.orderBy("year")))  # a row a year


@query(f"""WITH {LATEST}, s AS (SELECT paper_id, lower(trim(categories[1])) AS category, CASE WHEN y <= 2017 THEN 'foundational' WHEN y <= 2020 THEN 'established' WHEN y <= 2022 THEN 'recent' WHEN y >= 2023 THEN 'current' END AS bucket
  FROM (SELECT *, CAST(nullif(regexp_extract(published_date, '^(\\d{{4}})', 1), '') AS INT) AS y FROM latest)), k AS (SELECT * FROM s WHERE nullif(category, '') IS NOT NULL AND bucket IS NOT NULL),
g AS (SELECT c.category, b.bucket FROM (SELECT DISTINCT category FROM k) c CROSS JOIN (VALUES ('foundational'), ('established'), ('recent'), ('current')) b(bucket))
SELECT g.category, g.bucket, count(k.paper_id) AS available FROM g LEFT JOIN k ON k.category = g.category AND k.bucket = g.bucket GROUP BY 1, 2""")
def agg_strata_availability(spark, sf_dir):
    k = _strata(spark, sf_dir)
    eras = spark.createDataFrame([(e[0],) for e in S.ERAS], "bucket string")
    grid = k.select("category").distinct().crossJoin(F.broadcast(eras))  # four eras
    return grid.join(k.groupBy("category", "bucket").agg(F.count("*").alias("n")), ["category", "bucket"], "left").select("category", "bucket", F.coalesce("n", F.lit(0)).alias("available"))


def _strata(spark, sf_dir):
    p = papers(spark, sf_dir).select("paper_id", R.first_category(F.col("categories")).alias("category"), S.era(S.year_of(F.col("published_date"))).alias("bucket"))
    return p.where("category is not null and bucket is not null")


STRATA = f"""{LATEST}, s AS (SELECT paper_id, nullif(lower(trim(categories[1])), '') AS category, CASE WHEN y <= 2017 THEN 'foundational' WHEN y <= 2020 THEN 'established' WHEN y <= 2022 THEN 'recent' WHEN y >= 2023 THEN 'current' END AS bucket
  FROM (SELECT *, CAST(nullif(regexp_extract(published_date, '^(\\d{{4}})', 1), '') AS INT) AS y FROM latest)), k AS (SELECT * FROM s WHERE category IS NOT NULL AND bucket IS NOT NULL)"""
WEIGHTS = {"foundational": 15, "established": 20, "recent": 25, "current": 40}
QUOTAS = f"""{STRATA}, cats AS (SELECT category, row_number() OVER (ORDER BY category) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT category FROM k)),
sh AS (SELECT category, 400 // n + CASE WHEN rn <= 400 % n THEN 1 ELSE 0 END AS share FROM cats),
sp AS (SELECT category, bucket, share, share * w // 100 AS fl, share * w % 100 AS fr FROM sh CROSS JOIN (VALUES ('foundational', 15), ('established', 20), ('recent', 25), ('current', 40)) b(bucket, w)),
q AS (SELECT category, bucket, CAST(fl + CASE WHEN row_number() OVER (PARTITION BY category ORDER BY fr DESC, bucket DESC) <= share - sum(fl) OVER (PARTITION BY category) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM sp)"""


@query(f"WITH {QUOTAS} SELECT category, bucket, quota FROM q")
def scl_quotas(spark, sf_dir):
    return R.quotas(_strata(spark, sf_dir), 400, WEIGHTS)


@query(f"""WITH {QUOTAS}, r AS (SELECT k.*, q.quota, row_number() OVER (PARTITION BY k.category, k.bucket ORDER BY sha256('8420:' || paper_id), paper_id) AS rn FROM k JOIN q USING (category, bucket)) SELECT paper_id, category, bucket FROM r WHERE rn <= quota""")
def smp_stratified_quota(spark, sf_dir):
    k = _strata(spark, sf_dir)
    return R.stratified_sample(k.join(R.quotas(k, 400, WEIGHTS), ["category", "bucket"]), ["category", "bucket"], F.col("quota"), "paper_id", "8420").select("paper_id", "category", "bucket")


@query(f"WITH {QUOTAS}, a AS (SELECT category, bucket, count(*) AS n FROM k GROUP BY 1, 2) SELECT q.category, q.bucket, q.quota - coalesce(a.n, 0) AS deficit FROM q LEFT JOIN a USING (category, bucket) WHERE coalesce(a.n, 0) < q.quota")
def smp_deficits(spark, sf_dir):
    k = _strata(spark, sf_dir)
    have = k.groupBy("category", "bucket").agg(F.count("*").alias("n"))
    return R.quotas(k, 400, WEIGHTS).join(have, ["category", "bucket"], "left").where(F.coalesce("n", F.lit(0)) < F.col("quota")).select("category", "bucket", (F.col("quota") - F.coalesce("n", F.lit(0))).alias("deficit"))


@query(f"WITH {LATEST} SELECT paper_id FROM latest ORDER BY sha256('42:' || paper_id), paper_id LIMIT 300")
def smp_fixed_n(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id").orderBy(R.hash_order("42", "paper_id"), "paper_id").limit(300)


@query(f"""WITH {STRATA}, r AS (SELECT paper_id, category, row_number() OVER (PARTITION BY category ORDER BY sha256('7:' || paper_id), paper_id) AS rn, count(*) OVER (PARTITION BY category) AS n FROM k) SELECT paper_id, category, CASE WHEN rn <= n * 80 // 100 THEN 'train' ELSE 'test' END AS split FROM r""")
def smp_stratified_split(spark, sf_dir):
    return R.stratified_split(_strata(spark, sf_dir).select("paper_id", "category"), "paper_id", "category", "7", 80)


@query(f"""WITH {LATEST}, h AS (SELECT paper_id, CAST('0x' || left(sha256('11:' || paper_id), 8) AS BIGINT) % 100 AS b FROM latest) SELECT paper_id, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM h""")
def smp_hash_split(spark, sf_dir):
    return R.split_by_hash(papers(spark, sf_dir).select("paper_id"), "paper_id", "11", (("train", 80), ("validation", 10), ("test", 10)))


@query(f"""WITH {LATEST}, g AS (SELECT DISTINCT paper_id, title FROM (SELECT paper_id, title, row_number() OVER (PARTITION BY paper_id ORDER BY parsed_id) AS rn FROM parsed_papers WHERE paper_id IS NOT NULL) WHERE rn = 1)
SELECT l.paper_id, CASE WHEN coalesce(s2_enriched, false) THEN 'already' WHEN g.paper_id IS NOT NULL THEN 'found' ELSE 'not_found' END AS status FROM latest l LEFT JOIN g ON g.paper_id = l.paper_id""")
def jn_cache_enrich(spark, sf_dir):
    cache = table(spark, sf_dir, "parsed_papers").where("paper_id is not null").select("paper_id", F.lit(True).alias("hit")).distinct()
    return R.enrich(papers(spark, sf_dir), cache).select("paper_id", "status")


@query(f"""WITH {LATEST}, r AS (SELECT DISTINCT paper_id AS src, unnest(reference_ids) AS dst FROM latest), e AS (SELECT src, dst FROM r WHERE dst IN (SELECT paper_id FROM latest) AND src <> dst)
SELECT l.paper_id, coalesce(o.n, 0) AS cites, coalesce(i.n, 0) AS cited_by FROM latest l LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) o ON o.src = l.paper_id LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) i ON i.dst = l.paper_id""")
def jn_citation_degrees(spark, sf_dir):
    p = papers(spark, sf_dir)
    ids = p.select("paper_id")
    e = p.select(F.col("paper_id").alias("src"), F.explode("reference_ids").alias("dst")).distinct().where("src <> dst").join(ids.withColumnRenamed("paper_id", "dst"), "dst", "left_semi")
    out, back = e.groupBy(F.col("src").alias("paper_id")).agg(F.count("*").alias("o")), e.groupBy(F.col("dst").alias("paper_id")).agg(F.count("*").alias("i"))
    return ids.join(out, "paper_id", "left").join(back, "paper_id", "left").select("paper_id", F.coalesce("o", F.lit(0)).alias("cites"), F.coalesce("i", F.lit(0)).alias("cited_by"))


@query(f"""WITH {LATEST}, y AS (SELECT paper_id, lower(trim(categories[1])) AS category, citation_count AS c FROM latest WHERE nullif(trim(categories[1]), '') IS NOT NULL) SELECT category, paper_id, rn AS rank FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY c DESC NULLS LAST, paper_id) AS rn FROM y) WHERE rn <= 5""")
def top_cited_by_category(spark, sf_dir):
    y = papers(spark, sf_dir).select("paper_id", R.first_category(F.col("categories")).alias("category"), "citation_count").where("category is not null")
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.col("citation_count").desc_nulls_last(), "paper_id"))
    return y.withColumn("rank", rank).where("rank <= 5").select("category", "paper_id", "rank")


@query(f"WITH {LATEST} SELECT published_date, paper_id FROM latest WHERE published_date IS NOT NULL ORDER BY published_date DESC, paper_id DESC LIMIT 50")
def top_newest(spark, sf_dir):
    return papers(spark, sf_dir).where("published_date is not null").select("published_date", "paper_id").orderBy(F.desc("published_date"), F.desc("paper_id")).limit(50)


@query(f"""WITH {LATEST}, k AS (SELECT 'paper' AS origin, paper_id FROM latest UNION ALL SELECT 'flat', paper_id FROM flat_papers UNION ALL SELECT 'parsed', paper_id FROM parsed_papers UNION ALL SELECT 'document', paper_id FROM documents)
SELECT paper_id, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, count(*) AS rows_in FROM k WHERE paper_id IS NOT NULL GROUP BY paper_id""")
def set_pool_sources(spark, sf_dir):
    parts = {"paper": papers(spark, sf_dir), "flat": table(spark, sf_dir, "flat_papers"), "parsed": table(spark, sf_dir, "parsed_papers"), "document": table(spark, sf_dir, "documents")}
    pool = None
    for origin, df in parts.items():
        one = df.select(F.lit(origin).alias("origin"), "paper_id")
        pool = one if pool is None else pool.unionByName(one)
    return pool.where("paper_id is not null").groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_set("origin")), ",").alias("origins"), F.count("*").alias("rows_in"))


@query(f"WITH {LATEST} SELECT paper_id FROM latest EXCEPT SELECT paper_id FROM flat_papers")
def set_without_flat(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id").subtract(table(spark, sf_dir, "flat_papers").select("paper_id"))


@query("SELECT count(*) AS rows_in, count(DISTINCT paper_id) AS papers, count(paper_id) - count(DISTINCT paper_id) AS repeated FROM paper_records")
def set_duplicates(spark, sf_dir):
    return table(spark, sf_dir, "paper_records").agg(F.count("*").alias("rows_in"), F.count_distinct("paper_id").alias("papers"), (F.count("paper_id") - F.count_distinct("paper_id")).alias("repeated"))


@query(f"""WITH {LATEST}, y AS (SELECT paper_id, CAST(nullif(regexp_extract(published_date, '^(\\d{{4}})', 1), '') AS INT) AS y FROM latest)
SELECT paper_id, round(CASE WHEN y IS NULL THEN 0.5 ELSE greatest(0, 1 - 0.1 * greatest(0, 2024 - y)) END, 6) AS recency, CASE WHEN y <= 2017 THEN 'foundational' WHEN y <= 2020 THEN 'established' WHEN y <= 2022 THEN 'recent' WHEN y >= 2023 THEN 'current' ELSE '-' END AS era FROM y""")
def scl_recency_era(spark, sf_dir):
    y = papers(spark, sf_dir).select("paper_id", S.year_of(F.col("published_date")).alias("y"))
    return y.select("paper_id", F.round(S.recency(F.col("y")), 6).alias("recency"), F.coalesce(S.era(F.col("y")), F.lit("-")).alias("era"))


@query(f"""WITH {LATEST}, t AS (SELECT paper_id, published_date AS d, regexp_extract(arxiv_id, '^(\\d{{4}})\\.\\d{{4,5}}', 1) AS ym FROM latest)
SELECT paper_id, coalesce(try_cast(CASE WHEN d SIMILAR TO '\\d{{4}}-\\d{{2}}-\\d{{2}}.*' THEN substr(d, 1, 10) END AS DATE), try_cast(regexp_extract(d, '^(\\d{{4}}-\\d{{2}})', 1) || '-01' AS DATE),
  try_cast(CASE WHEN ym <> '' THEN CASE WHEN left(ym, 2) >= '91' THEN '19' ELSE '20' END || left(ym, 2) || '-' || substr(ym, 3, 2) || '-01' END AS DATE)) AS repaired FROM t""")
def scl_repaired_date(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", S.repaired_date(F.col("published_date"), F.col("arxiv_id")).alias("repaired"))


@query(f"""WITH {LATEST}, n AS (SELECT paper_id, list_filter(authors, lambda x: trim(x) <> '') AS a FROM latest),
w AS (SELECT paper_id, list_transform(a, lambda x: CASE WHEN len(regexp_split_to_array(trim(x), '\\s+')) > 1 THEN regexp_split_to_array(trim(x), '\\s+')[-1] || ', ' || array_to_string(list_transform(regexp_split_to_array(trim(x), '\\s+')[:-2], lambda y: upper(left(y, 1)) || '.'), ' ') ELSE trim(x) END) AS f FROM n)
SELECT paper_id, CASE WHEN coalesce(len(f), 0) = 0 THEN 'Unknown' WHEN len(f) = 1 THEN f[1] WHEN len(f) <= 20 THEN array_to_string(f[:-2], ', ') || ', & ' || f[-1] ELSE array_to_string(f[:19], ', ') || ', ... ' || f[-1] END AS apa FROM w""")
def txt_apa_authors(spark, sf_dir):
    return papers(spark, sf_dir).select("paper_id", X.apa_authors(F.col("authors")).alias("apa"))


@query()
def txt_apa_citation(spark, sf_dir):
    p = papers(spark, sf_dir)
    return p.select("paper_id", X.apa_citation(F.col("authors"), S.year_of(F.col("published_date")), F.col("title"), F.col("venue"), F.col("doi"), F.col("arxiv_id"), F.col("url")).alias("citation"))
