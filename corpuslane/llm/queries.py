"""Queries of the numbered problems and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuslane.llm import defects, lookalike, names, packing, sampling, scans, tokens
from corpuslane.runtime import cut_lineage, spread, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.unmet_targets(table(spark, sf_dir, "paper_records"), table(spark, sf_dir, "sample_targets")).select("plan_id", "category")


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.proportional_sample(table(spark, sf_dir, "paper_records"), table(spark, sf_dir, "sample_targets"))


def p1_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    primaries = sampling.primary_categories(table(spark, sf_dir, "paper_records"))
    return sampling.allocate(table(spark, sf_dir, "sample_targets"), sampling.category_counts(primaries))


def p3_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_names(table(spark, sf_dir, "paper_records"), cut_lineage)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_pairs(cut_lineage(p3_entities(spark, sf_dir)))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.Repair(table(spark, sf_dir, "parsed_papers"), cut_lineage).found()


def p4_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.Repair(table(spark, sf_dir, "parsed_papers"), cut_lineage).text()


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on all responses and on all that is planted into them, stored."""
    generations, prompts = spread(table(spark, sf_dir, "model_generations"), tasks_per_core=1), table(spark, sf_dir, "prompt_records")
    return cut_lineage(defects.with_votes(defects.prepare(defects.with_planted(generations, prompts), prompts)))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.one_defect(defects.labels(_votes(spark, sf_dir)))


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.labels(_votes(spark, sf_dir)).select("generation_id", "defect", "posterior")


def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(defects.validated_cutoffs(defects.pattern_odds(_votes(spark, sf_dir))[0]))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.count_tokens(table(spark, sf_dir, "documents"))
    return packing.fill_containers(sizes, table(spark, sf_dir, "container_sizes"), cut=cut_lineage)


def p7_best_fit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report for best fit alone, to see what evolution adds."""
    containers = table(spark, sf_dir, "container_sizes")
    return packing.fill_report(packing.fill_containers(tokens.count_tokens(table(spark, sf_dir, "documents")), containers, cut=cut_lineage, generations=0), containers)


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p7_fill(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p8_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.one_form(table(spark, sf_dir, "documents")).select("doc_id", "form")


def p8_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.form_members(lookalike.one_form(table(spark, sf_dir, "documents")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.same_looking_pairs(cut_lineage(lookalike.one_form(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_sample": p1_sample,
    "p1_allocation": p1_allocation,
    "p3_entities": p3_entities,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_text": p4_text,
    "p5_found": p5_found,
    "p5_labels": p5_labels,
    "p5_cutoffs": p5_cutoffs,
    "p6_ids": p6_ids,
    "p7_fill": p7_fill,
    "p7_report": p7_report,
    "p7_best_fit_report": p7_best_fit_report,
    "p8_found": p8_found,
    "p8_forms": p8_forms,
    "p8_members": p8_members,
}

P1_BASE = """
WITH p AS (SELECT DISTINCT paper_id, nullif(lower(trim(categories[1])), '') AS leaf FROM paper_records WHERE paper_id IS NOT NULL),
c AS (SELECT leaf, count(*) AS available FROM p WHERE leaf IS NOT NULL GROUP BY leaf),
n AS (SELECT count(DISTINCT paper_id) AS n FROM p WHERE leaf IS NOT NULL),
t AS (SELECT plan_id, category, greatest(min_rows, ((n.n * sample_permille) // 1000 * share_bp) // 10000) AS target, coalesce(c.available, 0) AS available
      FROM sample_targets s CROSS JOIN n LEFT JOIN c ON c.leaf = lower(trim(s.category)))
"""

ORACLE: dict[str, str] = {
    "p1_found": P1_BASE + "SELECT plan_id, category FROM t WHERE available < target",
}
