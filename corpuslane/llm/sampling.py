"""Problem 1: draw a sample whose category shares follow given targets.

Quotas go down a category tree (all -> archive -> category). What a category cannot fill goes to the other
categories of its archive (siblings) first and then to those of other archives (cousins), in proportion to what
they have left. Papers are drawn at the leaves by their rank in a seeded permutation.

Defined results for odd input: papers without a category (null, empty or blank first entry) or without an id
count nowhere; repeated rows count once; a target whose category no paper has gets ``available`` 0; null shares,
minimums or permilles count as 0; an empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_RANK_BUCKET = 100_000


def category_key(c: Column) -> Column:
    """Lower case without outer blanks; blank gives null."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def primary_categories(papers: DataFrame) -> DataFrame:
    """One row (paper_id, leaf) for each distinct paper with a first category."""
    return (
        papers.select("paper_id", category_key(F.get("categories", F.lit(0))).alias("leaf"))
        .where(F.col("paper_id").isNotNull() & F.col("leaf").isNotNull())
        .distinct()
    )


def category_counts(primaries: DataFrame) -> DataFrame:
    """(leaf, available, n): papers of each category and in all; as many rows as there are categories."""
    counts = primaries.groupBy("leaf").agg(F.count("*").alias("available"))
    total = primaries.agg(F.count_distinct("paper_id").alias("n"))
    return counts.crossJoin(F.broadcast(total))  # one row


def plan_targets(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """Targets with archive, sample size, target, available and shortfall for every row of ``targets``."""
    n = counts.agg(F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"))
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return (
        targets.select("plan_id", "category", "share_bp", "min_rows", "sample_permille").distinct()
        .crossJoin(F.broadcast(n))  # one row
        .withColumn("leaf", category_key(F.col("category")))
        .withColumn("archive", F.element_at(F.split("leaf", r"\."), 1))
        .withColumn("size", F.expr("n * cast(coalesce(sample_permille, 0) as bigint) div 1000"))
        .withColumn("target", F.greatest(whole("min_rows"), F.expr("size * cast(coalesce(share_bp, 0) as bigint) div 10000")))
        .join(counts.select("leaf", "available"), "leaf", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
        .withColumn("shortfall", F.greatest(F.col("target") - F.col("available"), F.lit(0)))
    )


def _share_out(df: DataFrame, keys: list[str], need: str, room: str, out: str) -> DataFrame:
    """Give ``need`` (one number a group) to the rows of the group in proportion to ``room``, by largest remainder."""
    group = Window.partitionBy(*keys)
    total = F.sum(room).over(group)
    give = F.least(F.col(need), total)
    exact = F.when(total > 0, give * F.col(room) / total).otherwise(F.lit(0.0))
    floor = F.least(F.floor(exact).cast("bigint"), F.col(room))
    df = df.withColumn("_floor", floor).withColumn("_frac", F.when(F.col(room) > F.col("_floor"), exact - F.col("_floor")).otherwise(F.lit(-1.0)))
    order = group.orderBy(F.desc("_frac"), F.asc("leaf"), F.asc("category"))
    rest = give - F.sum("_floor").over(group)
    df = df.withColumn("_rest", rest).withColumn("_rn", F.row_number().over(order))
    extra = F.when((F.col("_rn") <= F.col("_rest")) & (F.col(room) > F.col("_floor")), 1).otherwise(0)
    return df.withColumn(out, (F.col("_floor") + extra).cast("bigint")).drop("_floor", "_frac", "_rest", "_rn")


def allocate(targets: DataFrame, counts: DataFrame) -> DataFrame:
    """Quotas of each plan after passing on what could not be met.

    Columns: plan_id, category, leaf, archive, size, target, available, shortfall, own, from_siblings,
    from_cousins, quota, unfilled (what the whole plan could not place, the same on all its rows).
    """
    t = plan_targets(targets, counts)
    archive, plan = ["plan_id", "archive"], ["plan_id"]
    t = t.withColumn("own", F.least("target", "available")).withColumn("_room", F.col("available") - F.col("own"))
    t = t.withColumn("_need", F.sum("shortfall").over(Window.partitionBy(*archive)))
    t = _share_out(t, archive, "_need", "_room", "from_siblings")
    t = t.withColumn("_room", F.col("_room") - F.col("from_siblings"))
    placed = F.sum("from_siblings").over(Window.partitionBy(*plan))
    t = t.withColumn("_need", F.sum("shortfall").over(Window.partitionBy(*plan)) - placed)
    t = _share_out(t, plan, "_need", "_room", "from_cousins")
    t = t.withColumn("quota", F.col("own") + F.col("from_siblings") + F.col("from_cousins"))
    unfilled = F.col("_need") - F.sum("from_cousins").over(Window.partitionBy(*plan))
    return t.withColumn("unfilled", unfilled).drop("_room", "_need", "n", "share_bp", "min_rows", "sample_permille")


def permuted_rank(primaries: DataFrame, counts: DataFrame, seed: str, rows_per_bucket: int = ROWS_PER_RANK_BUCKET) -> DataFrame:
    """Dense rank (from 0) of each paper of a category in a seeded permutation, without one task for a category.

    The permutation key is a hash; its leading part cuts a category into as many ranges as its size asks for. Ranks
    are made inside ranges and shifted by the number of papers in the ranges before.
    """
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.col("paper_id")))
    ranges = F.ceil(F.col("available") / rows_per_bucket)
    bucket = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / float(2**32) * ranges).cast("int")
    keyed = primaries.withColumn("_key", key).join(counts.select("leaf", "available"), "leaf").withColumn("_bucket", bucket)
    ahead = Window.partitionBy("leaf").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("leaf", "_bucket").agg(F.count("*").alias("_n")).select("leaf", "_bucket", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("leaf", "_bucket").orderBy("_key", "paper_id")) - 1
    return keyed.withColumn("_inside", inside).join(starts, ["leaf", "_bucket"]).select("leaf", "paper_id", "available", (F.col("_start") + F.col("_inside")).alias("rank"))


def proportional_sample(papers: DataFrame, targets: DataFrame, seed: str = "corpuslane") -> DataFrame:
    """(plan_id, category, paper_id, draw): the sampled papers of every plan, ``draw`` counting from 1 in a category.

    A category is permuted once; each plan starts at its own place in that circle, so plans draw different papers.
    """
    primaries = primary_categories(papers)
    counts = category_counts(primaries)
    wanted = allocate(targets, counts).where("quota > 0").select("plan_id", "category", "leaf", "quota")
    ranked = permuted_rank(primaries, counts, seed)
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("plan_id").cast("string"), F.col("leaf"))), 1, 8), 16, 10).cast("bigint")
    return (
        ranked.join(wanted, "leaf")
        .withColumn("draw", F.pmod(F.col("rank") - start, F.col("available")) + 1)
        .where("draw <= quota")
        .select("plan_id", "category", "paper_id", F.col("draw").cast("bigint").alias("draw"))
    )


def unmet_targets(papers: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of :func:`allocate` whose category has fewer papers than its target."""
    return allocate(targets, category_counts(primary_categories(papers))).where("shortfall > 0")
