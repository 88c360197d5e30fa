"""Ranking metrics over (query_id, doc_id, rank) and gold (query_id, doc_id), and classification metrics.

Queries of the gold without results still have a row, with zeros. Repeated gold rows count once.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import scalars as S


def ranking_metrics(results: DataFrame, gold: DataFrame, k: int, by: tuple[str, ...] = (), depth: int = 10) -> DataFrame:
    """A row a query (and a group of ``by``): precision, recall, f1, ndcg at k, average precision and reciprocal rank.

    ``ndcg_retrieved`` orders only what was retrieved as its ideal; ``ndcg_standard`` takes all relevant documents.
    """
    gold = gold.select("query_id", "doc_id").distinct()
    relevant = gold.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = results.where(F.col("rank") <= depth).join(gold, ["query_id", "doc_id"], "left_semi")
    w = Window.partitionBy("query_id", *by).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("_so_far", F.count("*").over(w))
    at = F.col("rank") <= k
    gain = F.when(at, 1 / (F.log2(F.col("rank") + 1)))
    per = hits.groupBy("query_id", *by).agg(
        F.count_if(at).alias("hits"), F.sum(F.col("_so_far") / F.col("rank")).alias("_ap"), F.min("rank").alias("_first"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("_dcg")
    )
    groups = relevant
    if by:
        groups = relevant.crossJoin(F.broadcast(results.select(*by).distinct()))  # a few retrievers
    all_ = groups.join(per, ["query_id", *by], "left").na.fill(0, ["hits", "_ap", "_dcg"])
    ideal = lambda n: F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    p, r = F.col("hits") / k, S.ratio(F.col("hits"), F.col("relevant"))
    most = F.least(F.col("relevant"), F.lit(k))
    return all_.select(
        "query_id", *by, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(S.f1(p, r), 6).alias("f1"),
        F.round(F.when(F.col("hits") > 0, F.col("_dcg") / ideal(F.col("hits"))).otherwise(0.0), 6).alias("ndcg_retrieved"), F.round(F.col("_dcg") / ideal(most), 6).alias("ndcg_standard"),
        F.round(S.ratio(F.col("_ap"), F.col("relevant")), 6).alias("ap"), F.round(F.when(F.col("_first") > 0, 1 / F.col("_first")).otherwise(0.0), 6).alias("rr"),
    )


METRICS = ("precision", "recall", "f1", "ndcg_retrieved", "ndcg_standard", "ap", "rr")


def mean_metrics(per_query: DataFrame, by: str) -> DataFrame:
    return per_query.groupBy(by).agg(F.count("*").alias("queries"), *[F.round(F.avg(m), 4).alias(m) for m in METRICS])


def tradeoff(per_query: DataFrame, by: str, baseline: float) -> DataFrame:
    """A row a setting: means on query parts a and b, whether it is nowhere worse than the baseline setting
    (``balanced``), and whether it is at most 2 % worse on part a (``relaxed``). Without a baseline row nothing comes out."""
    # Measures have six digits; as decimals their mean is exact, whatever the order of rows.
    mean = lambda m, part: F.avg(F.when(F.col("part") == part, F.col(m).cast("decimal(18,6)")))
    names = {"map_a": ("ap", "a"), "ndcg_a": ("ndcg_standard", "a"), "map_b": ("ap", "b"), "ndcg_b": ("ndcg_standard", "b")}
    means = per_query.groupBy(by).agg(*[mean(*spec).alias(n) for n, spec in names.items()])
    base = means.where(F.col(by) == baseline).select(*[F.col(n).alias(f"_{n}") for n in names])
    least = lambda chosen, share: reduce(and_, [F.col(n).cast("double") >= F.col(f"_{n}").cast("double") * share - 1e-9 for n in chosen])
    both = means.crossJoin(F.broadcast(base))  # one row
    return both.select(by, *[F.round(n, 6).cast("double").alias(n) for n in names], least(names, 1.0).alias("balanced"), least(("map_a", "ndcg_a"), 0.98).alias("relaxed"))


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """A row an actual label, a column a predicted one."""
    return pairs.groupBy("actual").pivot("predicted", labels).count().na.fill(0, labels)


def class_metrics(pairs: DataFrame) -> DataFrame:
    """(label, support, precision, recall, f1) of (actual, predicted) rows."""
    counts = pairs.groupBy("actual", "predicted").agg(F.count("*").alias("n"))
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label"), "actual", "predicted", "n").dropDuplicates(["label", "actual", "predicted"])
    same = (F.col("actual") == F.col("label")) & (F.col("predicted") == F.col("label"))
    agg = labels.groupBy("label").agg(F.sum(F.when(F.col("actual") == F.col("label"), F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("predicted") == F.col("label"), F.col("n")).otherwise(0)).alias("guessed"), F.sum(F.when(same, F.col("n")).otherwise(0)).alias("right"))
    p, r = S.ratio(F.col("right"), F.col("guessed")), S.ratio(F.col("right"), F.col("support"))
    return agg.select("label", "support", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(S.f1(p, r), 6).alias("f1"))
