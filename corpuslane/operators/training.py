"""Training rows (source, task, key, user, assistant) from evidence packs and parsed papers, their merge and statistics.

Null or blank turns make no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import text as X

# Tasks over evidence packs: opening line, sources cited and whether their text is quoted.
PACK_TASKS = {
    "overview": ("The sources say the following.", 3, True),
    "citations": ("Cite these papers.", 5, False),
    "gaps": ("Open points beside these sources.", 2, False),
    "first_choice": ("The best match comes first.", 1, True),
    "follow_up": ("The answer rests on one source.", 1, True),
    "beginner": ("In plain words.", 2, True),
}
# Tasks over parsed papers: the section read and the section that answers.
PAPER_TASKS = {"paper_summary": ("introduction", "abstract"), "paper_findings": ("method", "results"), "paper_outlook": ("results", "conclusion")}


def instruction_rows(packs: DataFrame, queries: DataFrame) -> DataFrame:
    """One row a query and pack task; a row that cites nothing, or anything outside its pack, is dropped.

    ``packs`` holds the few numbered sources of each query (query_id, source_id, snippet), ``queries`` (query_id, text).
    """
    pack = packs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "snippet"))).alias("pack"))

    def answer(opening: str, most: int, quoted: bool) -> Column:
        line = lambda s: F.concat(F.lit("- "), s["snippet"] if quoted else F.lit("see"), F.lit(" ["), s["source_id"], F.lit("]"))
        return F.concat(F.lit(opening + "\n"), F.array_join(F.transform(F.slice("pack", 1, most), line), "\n"))

    made = F.array(*[F.struct(F.lit(t).alias("task"), answer(*spec).alias("assistant")) for t, spec in PACK_TASKS.items()])
    rows = pack.join(queries.select("query_id", F.col("text").alias("user")), "query_id").select("query_id", "user", F.transform("pack", lambda s: s["source_id"]).alias("available"), F.inline(made))
    used = X.output_source_ids(F.col("assistant"))
    kept = rows.where((F.size(used) > 0) & (F.size(F.array_except(used, "available")) == 0) & (F.trim("user") != ""))
    return kept.select(F.lit("packs").alias("source"), "task", F.col("query_id").cast("string").alias("key"), "user", "assistant")


def paper_rows(parsed: DataFrame, per_task: int) -> DataFrame:
    """The first ``per_task`` papers by parsed_id of each paper task that have both of its sections."""
    pairs = F.array(*[F.struct(F.lit(t).alias("task"), F.element_at("sections", F.lit(a)).alias("user"), F.element_at("sections", F.lit(b)).alias("assistant")) for t, (a, b) in PAPER_TASKS.items()])
    rows = parsed.select("parsed_id", F.inline(pairs)).where("trim(coalesce(user, '')) <> '' and trim(coalesce(assistant, '')) <> ''")
    order = F.row_number().over(Window.partitionBy("task").orderBy("parsed_id"))
    return rows.withColumn("_n", order).where(F.col("_n") <= per_task).select(F.lit("papers").alias("source"), "task", F.col("parsed_id").cast("string").alias("key"), "user", "assistant")


def deficits(rows: DataFrame, wanted: dict[str, int]) -> DataFrame:
    """(task, wanted, rows, deficit) for every wanted task, those without rows included."""
    spec = F.create_map(*[F.lit(x) for pair in wanted.items() for x in pair])
    counts = rows.groupBy("task").agg(F.count("*").alias("n"))
    tasks = rows.sparkSession.range(1).select(F.explode(spec).alias("task", "wanted"))
    n = F.coalesce("n", F.lit(0))
    return tasks.join(counts, "task", "left").select("task", F.col("wanted").cast("bigint").alias("wanted"), n.alias("rows"), F.greatest(F.col("wanted") - n, F.lit(0)).alias("deficit"))


def manifest(rows: DataFrame) -> DataFrame:
    """(source, task, rows, checksum); the checksum does not depend on the order of the rows."""
    word = F.conv(F.substring(F.md5(F.concat("user", F.lit("|"), "assistant")), 1, 8), 16, 10).cast("bigint")
    return rows.groupBy("source", "task").agg(F.count("*").alias("rows"), F.sum(word).alias("checksum"))


def statistics(rows: DataFrame) -> DataFrame:
    """(task, rows, mean, median and 95th percentile of the answer's characters, rows that cite a source)."""
    n = F.length("assistant")
    share = lambda p: F.expr(f"percentile_disc({p}) within group (order by length(assistant))").cast("bigint")
    return rows.groupBy("task").agg(F.count("*").alias("rows"), F.round(F.avg(n), 4).alias("mean_chars"), share(0.5).alias("p50"), share(0.95).alias("p95"), F.count_if(F.col("assistant").rlike(r"\[S\d+\]")).alias("cited"))
