"""Paper records: the current version of each, cleaning, validation, joins to caches, strata, quotas and splits.

Rows without the key that an operator works by are left out; all results are independent of row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import scalars as S
from corpuslane.functions import text as X

SOURCES = ("arxiv", "semantic_scholar", "openalex", "acl", "pubmed", "kaggle")
FIELDS = ("title", "abstract", "authors", "categories", "published_date", "venue", "doi", "tldr")


def latest(papers: DataFrame) -> DataFrame:
    """One row a paper: the last loaded, then the most cited. Partial aggregation, so a paper loaded often is no hot task."""
    order = F.struct(F.col("loaded_at"), F.coalesce("citation_count", F.lit(-1)), F.coalesce("influential_citation_count", F.lit(-1)))
    best = papers.where("paper_id is not null").groupBy("paper_id").agg(F.max_by(F.struct("*"), order).alias("_r"))
    return best.select("_r.*")


#: So many repeated ids at most are broadcast by :func:`one_text`.
REPEATED_IDS_SENT = 1_000_000


def one_text(docs: DataFrame) -> DataFrame:
    """One row (doc_id, text) a document, with its greatest text where it is repeated.

    Ids alone are counted first; only the texts of repeated ones are then grouped, and all of them only where more ids
    are repeated than can be sent to every task.
    """
    known = docs.where("doc_id is not null").select("doc_id", "text")
    greatest = lambda df: df.groupBy("doc_id").agg(F.max("text").alias("text"))
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select("doc_id")
    n = repeated.limit(REPEATED_IDS_SENT + 1).count()
    if n > REPEATED_IDS_SENT:
        return greatest(known)
    if n == 0:
        return known
    ids = F.broadcast(repeated)
    return known.join(ids, "doc_id", "left_anti").unionByName(greatest(known.join(ids, "doc_id", "left_semi")))


def primary_by_position(categories: Column, targets: list[str]) -> Column:
    """The first of a paper's own categories that is a target."""
    wanted = F.array(*[F.lit(t.lower()) for t in targets])
    return F.get(F.filter(F.transform(categories, lambda c: F.lower(F.trim(c))), lambda c: F.array_contains(wanted, c)), F.lit(0))


def primary_by_priority(categories: Column, targets: list[str]) -> Column:
    """The first target, in target order, that a paper has."""
    own = F.transform(categories, lambda c: F.lower(F.trim(c)))
    return F.get(F.filter(F.array(*[F.lit(t.lower()) for t in targets]), lambda t: F.coalesce(F.array_contains(own, t), F.lit(False))), F.lit(0))


def first_category(categories: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.get(categories, F.lit(0)))), F.lit(""))


def problems(papers: DataFrame) -> DataFrame:
    """(paper_id, problem): one row for each way in which a record breaks the contract."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    found = F.array(
        F.when(blank("title"), "missing title"), F.when(blank("abstract"), "missing abstract"), F.when(blank("published_date"), "missing published_date"),
        F.when(F.coalesce(F.size("authors"), F.lit(0)) <= 0, "empty authors"), F.when(F.coalesce(F.size("categories"), F.lit(0)) <= 0, "empty categories"),
        F.when(~F.coalesce(F.col("source"), F.lit("")).isin(*SOURCES), "unknown source"), F.when(F.coalesce("citation_count", F.lit(0)) < 0, "negative count"),
    )
    return papers.select("paper_id", F.explode(F.filter(found, lambda p: p.isNotNull())).alias("problem"))


def audit(papers: DataFrame) -> DataFrame:
    """(field, present, missing, pct_missing): long form, one pass over the data."""
    filled = {f: (F.coalesce(F.size(f), F.lit(0)) > 0 if f in ("authors", "categories") else F.trim(F.coalesce(f, F.lit(""))) != "") for f in FIELDS}
    one = papers.agg(F.count("*").alias("n"), *[F.count_if(c).alias(f) for f, c in filled.items()])
    long = one.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in FIELDS])).alias("_f")).select("_f.field", "_f.present", "n")
    return long.select("field", "present", (F.col("n") - F.col("present")).alias("missing"), F.round(S.ratio((F.col("n") - F.col("present")) * 100.0, F.col("n")), 4).alias("pct_missing"))


def derived(papers: DataFrame) -> DataFrame:
    """Exploration columns: counts of words, authors and categories, year, month, and which fields are there."""
    there = lambda c: (F.trim(F.coalesce(c, F.lit(""))) != "").cast("int")
    return papers.select(
        "paper_id", X.word_count(F.col("title")).alias("title_words"), X.word_count(F.col("abstract")).alias("abstract_words"),
        F.greatest(F.coalesce(F.size("authors"), F.lit(0)), F.lit(0)).alias("n_authors"), F.greatest(F.coalesce(F.size("categories"), F.lit(0)), F.lit(0)).alias("n_categories"),
        S.year_of(F.col("published_date")).alias("year"), F.nullif(F.regexp_extract("published_date", r"^\d{4}-(\d{2})", 1), F.lit("")).cast("int").alias("month"),
        there("doi").alias("has_doi"), there("venue").alias("has_venue"), there("tldr").alias("has_tldr"), F.greatest(F.coalesce(F.size("reference_ids"), F.lit(0)), F.lit(0)).alias("ref_count"),
    )


def to_flat(papers: DataFrame) -> DataFrame:
    """The six-key string form."""
    return papers.select("paper_id", X.clean_text(F.col("title")).alias("title"), X.clean_text(F.col("abstract")).alias("abstract"), F.array_join("authors", ", ").alias("authors"), F.array_join("categories", " ").alias("categories"), F.coalesce("published_date", F.lit("")).alias("update_date"))


def hash_order(seed: str, key: str) -> Column:
    """A seeded order that any engine with SHA-256 gives alike."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def quotas(strata: DataFrame, total: int, weights: dict[str, int]) -> DataFrame:
    """(category, bucket, quota): equal shares by category, then largest remainder by bucket weight (in percent).

    The first categories get what does not divide evenly; equal remainders go to the bucket name that comes last.
    """
    categories = strata.select("category").where("category is not null").distinct()
    rank = categories.withColumn("_rn", F.row_number().over(Window.orderBy("category"))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    share = rank.withColumn("_share", F.floor(F.lit(total) / F.col("_n")) + F.when(F.col("_rn") <= F.lit(total) % F.col("_n"), 1).otherwise(0))
    exact = F.col("_share") * F.col("_w") / 100
    split = share.withColumn("_b", F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.lit(w).alias("w")) for b, w in weights.items()]))).select("category", "_share", F.col("_b.bucket").alias("bucket"), F.col("_b.w").alias("_w"))
    split = split.withColumn("_floor", F.floor(exact)).withColumn("_frac", F.round(exact - F.floor(exact), 9))
    left = F.col("_share") - F.sum("_floor").over(Window.partitionBy("category"))
    order = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("_frac"), F.desc("bucket")))
    return split.withColumn("_left", left).withColumn("_order", order).select("category", "bucket", (F.col("_floor") + F.when(F.col("_order") <= F.col("_left"), 1).otherwise(0)).cast("bigint").alias("quota"))


def hash_ranks(rows: DataFrame, strata: list[str], key: str, seed: str, digits: int = 3) -> DataFrame:
    """Adds ``_rn``, the place of each row in the seeded hash order of its stratum from 1, and ``_size``, the rows of the stratum.

    The leading hexadecimal digits of the hash cut a stratum into slices (at most 16 to the number of digits). Rows are
    ranked inside slices and shifted by the rows of the slices before, so a hot stratum is never sorted in one task.
    ``rows`` is read twice.
    """
    cut = rows.withColumn("_hash", hash_order(seed, key)).withColumn("_slice", F.coalesce(F.substring("_hash", 1, digits), F.lit("")))
    by = [F.col(c).alias(f"_by{i}") for i, c in enumerate(strata)]
    group = Window.partitionBy(*[f"_by{i}" for i in range(len(strata))])
    counts = cut.groupBy(*by, F.col("_slice").alias("_at")).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(group.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_size", F.sum("_n").over(group)).drop("_n")
    same = F.col("_slice") == F.col("_at")
    for i, c in enumerate(strata):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = F.row_number().over(Window.partitionBy(*strata, "_slice").orderBy("_hash", key))
    placed = cut.withColumn("_inside", inside).join(starts, same)
    return placed.withColumn("_rn", F.col("_start") + F.col("_inside")).select(*rows.columns, "_rn", "_size")


def stratified_sample(rows: DataFrame, strata: list[str], quota: Column, key: str, seed: str) -> DataFrame:
    """At most ``quota`` rows of each stratum, by seeded hash order."""
    return hash_ranks(rows, strata, key, seed).where(F.col("_rn") <= quota).drop("_rn", "_size")


def split_by_hash(rows: DataFrame, key: str, seed: str, parts: tuple[tuple[str, int], ...]) -> DataFrame:
    """``split``: the part that each key falls into, by the leading 8 hexadecimal digits of its seeded hash.

    Shares hold in expectation; the same key is always in the same part, and no sort or shuffle is needed.
    """
    place = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("bigint") % 100
    out, upto = F.lit(parts[-1][0]), 0
    bounds = []
    for name, percent in parts[:-1]:
        upto += percent
        bounds.append((name, upto))
    for name, bound in reversed(bounds):
        out = F.when(place < bound, name).otherwise(out)
    return rows.withColumn("split", out)


def stratified_split(rows: DataFrame, key: str, label: str, seed: str, train_percent: int) -> DataFrame:
    """Exact shares within each label: the first floor(n * percent / 100) of the seeded order are ``train``."""
    cut = F.floor(F.col("_size") * train_percent / 100)
    return hash_ranks(rows, [label], key, seed).withColumn("split", F.when(F.col("_rn") <= cut, "train").otherwise("test")).drop("_rn", "_size")


def nearest_percentile(df: DataFrame, value: str, shares: list[float], by: list[str]) -> DataFrame:
    """Values at index round_half_even((n - 1) * q) of the sorted non-null values, one column for each share."""
    ranked = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_c").over(Window.partitionBy(*by))
    placed = ranked.withColumn("_to", upto).withColumn("_n", total)
    at = lambda q: F.bround((F.col("_n") - 1) * q, 0)
    pick = [F.max(F.when((F.col("_to") > at(q)) & (F.col("_to") - F.col("_c") <= at(q)), F.col(value))).alias(f"p{round(q * 100)}") for q in shares]
    return placed.groupBy(*by).agg(*pick)


def enrich(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """Left join to a cache (paper_id, hit, tldr, citations): status already, found or not_found, with defaults."""
    joined = papers.join(cache, "paper_id", "left")
    status = F.when(F.coalesce("s2_enriched", F.lit(False)), "already").when(F.coalesce("hit", F.lit(False)), "found").otherwise("not_found")
    return joined.withColumn("status", status)
