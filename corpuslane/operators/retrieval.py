"""Retrieval over postings and vectors, and the fusion of ranked lists.

An index is postings (doc_id, dl, term, tf), terms (term, df), documents (doc_id, dl, norm) and one row of statistics
(n, avgdl). :func:`build_index` plans one anew, :func:`stored_index` writes it once for a corpus and finds it again by
the fingerprint of the corpus and the analyzer. Queries are rows (query_id, text), or their terms (query_id, term, qtf).
Only terms of the queries meet the postings; scores are sums over equal terms, so no document is compared with a query
that shares nothing with it. Results are (query_id, doc_id, score, rank).

Null and empty documents count in N and in the mean length but match nothing; repeated doc_ids are one document with
its greatest text; documents and queries with a null id are left out; ties go to the smaller doc_id.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslane.functions import scalars as S
from corpuslane.functions import text as X
from corpuslane.operators.records import one_text

DIGITS = 9
#: Vectors and queries of a block of :func:`nearest`.
VECTORS_PER_BLOCK, QUERIES_PER_BLOCK = 4096, 1024


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame  # one row: n, avgdl


def _postings(docs: DataFrame, analyzer) -> DataFrame:
    words = docs.select("doc_id", analyzer(F.col("text")).alias("w")).select("doc_id", F.size("w").cast("bigint").alias("dl"), F.explode("w").alias("term"))
    return words.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def _idf() -> Column:
    return F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1


def _documents(ids: DataFrame, postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, dl, norm) of all documents; those without terms have neither length nor norm."""
    n = ids.agg(F.count("*").alias("n"))
    weighted = postings.join(terms, "term").crossJoin(F.broadcast(n))  # one row
    norms = weighted.groupBy("doc_id").agg(F.max("dl").alias("dl"), F.sqrt(F.sum(F.pow(F.col("tf") * _idf(), 2))).alias("norm"))
    return ids.join(norms, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(0)).alias("dl"), F.coalesce("norm", F.lit(0.0)).alias("norm"))


def build_index(docs: DataFrame, analyzer: Callable[[Column], Column] = X.content_tokens, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> Index:
    """Postings, document frequencies, lengths, norms and corpus statistics of (doc_id, text)."""
    one = one_text(docs)
    postings = cut(_postings(one, analyzer))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    lengths = _documents(one.select("doc_id"), postings, terms)
    return Index(postings, terms, lengths, lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")))


def analyzer_print(analyzer: Callable[[Column], Column]) -> str:
    """A digest of the analyzer's expression; the running numbers of lambda variables are left out."""
    return hashlib.sha256(re.sub(r"_\d+", "", str(analyzer(F.col("text")))).encode()).hexdigest()[:16]


def corpus_print(docs: DataFrame) -> str:
    """A digest of all (doc_id, text) that depends neither on their order nor on their partitions."""
    sums = [F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string") for h in (F.xxhash64("doc_id", "text"), F.hash("text", "doc_id"))]
    return docs.agg(F.concat_ws(":", F.count("*").cast("string"), *sums).alias("digest")).head().digest


def saved_index(spark: SparkSession, folder: str, analyzer_name: str, digest: str) -> Index | None:
    """The stored index of exactly this corpus and analyzer; None without one, or where its tables are gone."""
    try:
        found = spark.read.parquet(f"{folder}/meta").where((F.col("analyzer") == analyzer_name) & (F.col("digest") == digest)).orderBy("path").head()
        return found and Index(*[spark.read.parquet(f"{found.path}/{part}") for part in ("postings", "terms", "docs", "stats")])
    except AnalysisException:
        return None


def stored_index(docs: DataFrame, folder: str, analyzer: Callable[[Column], Column] = X.content_tokens) -> Index:
    """The index of (doc_id, text) in ``folder``, written there first if the corpus or the analyzer is new.

    Postings keep the partitions of their counting, which spread a common term over all of them, and are sorted by
    term inside, so that a scan skips the row groups without the terms asked for. The row in ``meta`` is written last:
    an index cut short is never found.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    name, digest = analyzer_print(analyzer), corpus_print(docs)
    found = saved_index(spark, folder, name, digest)
    if found:
        return found
    path = f"{folder}/{uuid4().hex}"

    def kept(df: DataFrame, part: str) -> DataFrame:
        df.write.parquet(f"{path}/{part}")
        return spark.read.schema(df.schema).parquet(f"{path}/{part}")

    one = one_text(docs)
    postings = kept(_postings(one, analyzer).sortWithinPartitions("term", "doc_id"), "postings")
    terms = kept(postings.groupBy("term").agg(F.count("*").alias("df")), "terms")
    lengths = kept(_documents(one.select("doc_id"), postings, terms), "docs")
    stats = kept(lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), "stats")
    spark.createDataFrame([(name, digest, path)], "analyzer string, digest string, path string").write.mode("append").parquet(f"{folder}/meta")
    return Index(postings, terms, lengths, stats)


def query_terms(queries: DataFrame, analyzer: Callable[[Column], Column] = X.content_tokens) -> DataFrame:
    """(query_id, term, qtf)."""
    if "qtf" in queries.columns:
        return queries.select("query_id", "term", "qtf")
    return queries.where("query_id is not null").select("query_id", F.explode(analyzer(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def documents_as_queries(index: Index, chosen: Column) -> DataFrame:
    """The whole texts of the documents that ``chosen`` picks as queries, read from the index as (query_id, term, qtf)."""
    return index.postings.where(chosen).select(F.col("doc_id").alias("query_id"), "term", F.col("tf").alias("qtf"))


def top_k(scores: DataFrame, k: int | None, key: str = "doc_id", by: str = "query_id") -> DataFrame:
    """The k best of each query, best first; scores are rounded before they are compared, so ties are true ties.

    Without k, all scores unranked.
    """
    rounded = scores.withColumn("score", F.round("score", DIGITS))
    if k is None:
        return rounded
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), key))
    return rounded.withColumn("rank", rank).where(F.col("rank") <= k)


def _matches(index: Index, queries: DataFrame, analyzer) -> DataFrame:
    """Query terms beside the postings that hold them, with df and corpus statistics."""
    q = query_terms(queries, analyzer).join(index.terms, "term").crossJoin(F.broadcast(index.stats))  # one row
    return q.join(index.postings, "term")


def tfidf(index: Index, queries: DataFrame, k: int | None, analyzer=X.content_tokens) -> DataFrame:
    """Cosine of raw tf times smooth idf, ln((1 + n) / (1 + df)) + 1, with unit rows."""
    idf = _idf()
    q = query_terms(queries, analyzer).join(index.terms, "term").crossJoin(F.broadcast(index.stats)).withColumn("qw", F.col("qtf") * idf)  # one row
    q = q.withColumn("qnorm", F.sqrt(F.sum(F.pow("qw", 2)).over(Window.partitionBy("query_id"))))
    dots = q.join(index.postings, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") / F.col("qnorm") * F.col("tf") * idf).alias("dot"))
    return top_k(dots.join(index.docs, "doc_id").select("query_id", "doc_id", (F.col("dot") / F.col("norm")).alias("score")).where("score > 0"), k)


def bm25(index: Index, queries: DataFrame, k: int | None, k1: float = 1.5, b: float = 0.75, variant: str = "okapi", delta: float = 0.5, analyzer=X.content_tokens) -> DataFrame:
    """Okapi, L or Plus. Okapi floors negative idf at a quarter of the mean idf; L and Plus use positive idf.

    L and Plus give a document without a term a constant share in the literature; that constant is the same for all
    documents of a query and is left out, so only matching documents get a score.
    """
    m = _matches(index, queries, analyzer)
    ratio = 1 - b + b * F.col("dl") / F.col("avgdl")
    tf = F.col("tf").cast("double")
    if variant == "okapi":
        raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        mean = index.terms.crossJoin(F.broadcast(index.stats)).agg(F.avg(raw).alias("mean_idf"))  # one row
        m = m.crossJoin(F.broadcast(mean))
        weight = F.when(raw < 0, 0.25 * F.col("mean_idf")).otherwise(raw) * tf * (k1 + 1) / (tf + k1 * ratio)
    elif variant == "l":
        ctd = tf / ratio
        weight = F.log((F.col("n") + 1) / (F.col("df") + 0.5)) * (k1 + 1) * (ctd + delta) / (k1 + ctd + delta)
    elif variant == "plus":
        weight = F.log((F.col("n") + 1) / F.col("df")) * (delta + tf * (k1 + 1) / (tf + k1 * ratio))
    else:
        raise ValueError(f"no such variant: {variant}")
    return top_k(m.groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * weight).alias("score")).where("score > 0"), k)


def lexical_scores(index: Index, queries: DataFrame, k1: float = 1.5, b: float = 0.75, analyzer=X.content_tokens) -> DataFrame:
    """(query_id, doc_id, tfidf, bm25): :func:`tfidf` and Okapi :func:`bm25` of all matching documents, unranked, from
    one pass over the postings. A score that is not above 0 is null."""
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = index.terms.crossJoin(F.broadcast(index.stats)).agg(F.avg(raw).alias("mean_idf"))  # one row
    q = query_terms(queries, analyzer).join(index.terms, "term").crossJoin(F.broadcast(index.stats)).crossJoin(F.broadcast(mean))  # one row each
    q = q.withColumns({"_t": F.col("qtf") * _idf() * _idf(), "_b": F.col("qtf") * F.when(raw < 0, 0.25 * F.col("mean_idf")).otherwise(raw) * (k1 + 1), "_w": F.pow(F.col("qtf") * _idf(), 2)})
    lengths = q.groupBy("query_id").agg(F.sqrt(F.sum("_w")).alias("qnorm"))
    tf = F.col("tf").cast("double")
    sums = q.select("query_id", "term", "avgdl", "_t", "_b").join(index.postings, "term").groupBy("query_id", "doc_id").agg(
        F.sum(F.col("_t") * tf).alias("_dot"), F.sum(F.col("_b") * tf / (tf + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).alias("_bm"))
    above = lambda c: F.when(c > 0, F.round(c, DIGITS))
    scored = sums.join(index.docs, "doc_id").join(lengths, "query_id").select("query_id", "doc_id", above(F.col("_dot") / F.col("qnorm") / F.col("norm")).alias("tfidf"), above(F.col("_bm")).alias("bm25"))
    return scored.where("tfidf is not null or bm25 is not null")


def top_terms(index: Index, k: int) -> DataFrame:
    """(doc_id, term, weight, rank): the heaviest terms of every document."""
    idf = _idf()
    w = index.postings.join(index.terms, "term").crossJoin(F.broadcast(index.stats)).select("doc_id", "term", F.round(F.col("tf") * idf, DIGITS).alias("weight"))  # one row
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("weight"), "term"))
    return w.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    """Exact search: the k vectors of (doc_id, vec) with the largest dot product with each (query_id, qvec); all without k.

    Every vector meets every query, in blocks of bounded size; a pair of blocks keeps k a query, and the best of all
    blocks are merged. Null vectors are left out.
    """
    import numpy as np
    import pandas as pd

    def blocks(df: DataFrame, key: str, value: str, size: int, name: str) -> DataFrame:
        known = df.where(F.col(value).isNotNull() & F.col(key).isNotNull()).select(key, value)
        many = max(1, -(-known.count() // size))
        return known.groupBy(F.pmod(F.xxhash64(key), F.lit(many)).alias("_block")).agg(F.collect_list(F.struct(key, value)).alias(name)).drop("_block")

    def run(frames):
        for frame in frames:
            for ds, qs in zip(frame["ds"], frame["qs"]):
                m = np.stack([np.asarray(d["vec"], dtype=np.float64) for d in ds])
                q = np.stack([np.asarray(x["qvec"], dtype=np.float64) for x in qs])
                scores = np.round(q @ m.T, DIGITS)
                ids, names = np.asarray([d["doc_id"] for d in ds]), np.asarray([x["query_id"] for x in qs])
                order = np.stack([np.lexsort((ids, -row))[:k] for row in scores])
                yield pd.DataFrame({"query_id": np.repeat(names, order.shape[1]), "doc_id": ids[order].ravel(), "score": np.take_along_axis(scores, order, axis=1).ravel()})

    # Blocks of the stated query set against blocks of all vectors.
    pairs = blocks(vectors, "doc_id", "vec", VECTORS_PER_BLOCK, "ds").crossJoin(blocks(queries, "query_id", "qvec", QUERIES_PER_BLOCK, "qs"))
    return top_k(pairs.select("ds", "qs").mapInPandas(run, "query_id bigint, doc_id bigint, score double"), k)


def min_max(scores: DataFrame, by: tuple[str, ...] = ("query_id", "component")) -> DataFrame:
    """``normal``: scores scaled to 0..1 in each group; 0.5 where all are alike."""
    w = Window.partitionBy(*by)
    low, high = F.min("score").over(w), F.max("score").over(w)
    return scores.withColumn("normal", F.when(high - low < 1e-9, 0.5).otherwise((F.col("score") - low) / (high - low)))


def reciprocal_rank_fusion(lists: DataFrame, weights: dict[str, float], k: int, constant: int = 60) -> DataFrame:
    """Sum of weight / (constant + rank) over the lists (query_id, doc_id, rank, component) that hold a document."""
    weight = F.coalesce(*[F.when(F.col("component") == c, F.lit(w)) for c, w in weights.items()], F.lit(0.0))
    ranks = [F.coalesce(F.max(F.when(F.col("component") == c, F.col("rank"))), F.lit(0)).cast("bigint").alias(f"{c}_rank") for c in weights]
    fused = lists.groupBy("query_id", "doc_id").agg(F.sum(weight / (constant + F.col("rank"))).alias("score"), *ranks)
    return top_k(fused, k)


def weighted_fusion(scores: DataFrame, weights: dict[str, float], k: int) -> DataFrame:
    """Sum of weight times min-max normalised score; a missing component counts 0."""
    weight = F.coalesce(*[F.when(F.col("component") == c, F.lit(w)) for c, w in weights.items()], F.lit(0.0))
    return top_k(min_max(scores).groupBy("query_id", "doc_id").agg(F.sum(weight * F.col("normal")).alias("score")), k)


def full_ranks(scores: DataFrame, by: tuple[str, ...] = ("query_id",), rows_per_range: int = 100_000) -> DataFrame:
    """``rank`` of every row by falling score, then doc_id, without one task for a group.

    A group is cut into score ranges by its size; ranks are made inside ranges and shifted by the rows in better ones.
    ``scores`` is read three times.
    """
    keys = list(by)
    spans = scores.groupBy(*keys).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.ceil(F.count("*") / rows_per_range).alias("_ranges"))
    place = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col("_hi") - F.col("score")) / (F.col("_hi") - F.col("_lo")) * (F.col("_ranges") - 1))).otherwise(F.lit(0))
    placed = scores.join(spans, keys).withColumn("_range", place.cast("bigint"))
    better = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).select(*keys, "_range", F.coalesce(F.sum("_n").over(better), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(F.desc("score"), "doc_id"))
    return placed.withColumn("_inside", inside).join(starts, [*keys, "_range"]).select(*scores.columns, (F.col("_start") + F.col("_inside")).alias("rank"))


def side_by_side(scores: DataFrame, components: tuple[str, ...]) -> DataFrame:
    """(query_id, doc_id, one score a component) from (query_id, doc_id, score, component); null where a list lacks the document."""
    return scores.groupBy("query_id", "doc_id").agg(*[F.max(F.when(F.col("component") == c, F.col("score"))).alias(c) for c in components])


def min_max_columns(pairs: DataFrame, components: tuple[str, ...]) -> DataFrame:
    """:func:`side_by_side` with each component scaled to 0..1 by query, a missing one as 0; extremes are grouped, not windowed."""
    ends = pairs.groupBy("query_id").agg(*[f(c).alias(f"_{n}_{c}") for c in components for n, f in (("lo", F.min), ("hi", F.max))])
    normal = lambda c: F.when(F.col(f"_hi_{c}") - F.col(f"_lo_{c}") < 1e-9, 0.5).otherwise((F.col(c) - F.col(f"_lo_{c}")) / (F.col(f"_hi_{c}") - F.col(f"_lo_{c}")))
    return pairs.join(ends, "query_id").select("query_id", "doc_id", *[F.when(F.col(c).isNull(), 0.0).otherwise(normal(c)).alias(c) for c in components])


def may_lead(two: DataFrame, k: int, a: str, b: str) -> DataFrame:
    """The rows that can be among the k best of their query for some weight between ``a`` and ``b``; no other can.

    Any weighting of a row lies between its two scores, so k rows with both scores above its greater one shut it out.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_low")))
    bar = two.select("query_id", low.alias("_low")).withColumn("_rn", rank).where(F.col("_rn") <= k).groupBy("query_id").agg(F.when(F.count("*") == k, F.min("_low")).alias("_bar"))
    return two.join(bar, "query_id").where(F.col("_bar").isNull() | (high >= F.col("_bar") - 1e-8)).drop("_bar")


def relation(score: Column, year: Column) -> Column:
    return F.when(score >= 0.8, "core").when(S.recency(year) >= 0.9, "recent").when(score >= 0.5, "supporting").otherwise("background")


def promote(scores: DataFrame, matches: Column, k: int) -> DataFrame:
    """Ranks anew with matching rows first, each part in its order; without a match it is the order by score."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.coalesce(matches, F.lit(False))), F.desc("score"), "doc_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def evidence_pack(ranked: DataFrame, docs: DataFrame, chars: int, most: int) -> DataFrame:
    """(query_id, source_id, doc_id, score, snippet): the first ``most`` hits of each query as numbered sources.

    Texts are joined to the kept hits only; scores are squashed by the best of the query.
    """
    top = ranked.where(F.col("rank") <= most).withColumn("_best", F.max("score").over(Window.partitionBy("query_id")))
    joined = top.join(docs, "doc_id")
    return joined.select("query_id", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("source_id"), "doc_id", S.squash(F.col("score"), F.col("_best")).alias("score"), X.snippet(X.clean_text(F.col("text")), chars).alias("snippet"))


def bm25_grid(index: Index, queries: DataFrame, k: int, grid: list[tuple[float, float]], analyzer=X.content_tokens) -> DataFrame:
    """Okapi scores for every (k1, b) of a small grid over one pass of the postings: (k1, b, query_id, doc_id, score, rank)."""
    raw = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = index.terms.crossJoin(F.broadcast(index.stats)).agg(F.avg(raw).alias("mean_idf"))  # one row
    m = _matches(index, queries, analyzer).crossJoin(F.broadcast(mean))
    tf = F.col("tf").cast("double")
    ratio = lambda b: 1 - b + b * F.col("dl") / F.col("avgdl")
    weight = F.col("qtf") * F.when(raw < 0, 0.25 * F.col("mean_idf")).otherwise(raw)
    sums = [F.sum(weight * tf * (k1 + 1) / (tf + k1 * ratio(b))).alias(f"s{i}") for i, (k1, b) in enumerate(grid)]
    rows = F.array(*[F.struct(F.lit(k1).alias("k1"), F.lit(b).alias("b"), F.col(f"s{i}").alias("score")) for i, (k1, b) in enumerate(grid)])
    scored = m.groupBy("query_id", "doc_id").agg(*sums).select("query_id", "doc_id", F.inline(rows)).where("score > 0").withColumn("score", F.round("score", DIGITS))
    rank = F.row_number().over(Window.partitionBy("k1", "b", "query_id").orderBy(F.desc("score"), "doc_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def role_weighted(vectors: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc_id, vec) from (doc_id, role, vec): the weighted sum over roles.

    Its dot product with a query is the weighted sum of the roles' dot products, so ``nearest`` over it ranks by
    sections at the price of one vector a document. A missing role adds nothing; of repeated ones the greatest counts;
    rows without id or vector and other roles are left out.
    """
    known = vectors.where(F.col("doc_id").isNotNull() & F.col("vec").isNotNull() & F.col("role").isin(*weights))
    one = known.groupBy("doc_id").agg(*[F.max(F.when(F.col("role") == r, F.col("vec"))).alias(f"v{i}") for i, r in enumerate(weights)])
    scaled = lambda c, w: F.transform(c, lambda x: x.cast("double") * w)
    total = None
    for i, w in enumerate(weights.values()):
        part = scaled(F.col(f"v{i}"), w)
        total = part if total is None else F.coalesce(F.zip_with(total, part, lambda a, b: a + b), total, part)
    return one.select("doc_id", total.alias("vec"))
