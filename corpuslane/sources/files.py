"""Readers and writers for semi-structured files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW_RECORD = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("abstract", T.StringType()), T.StructField("authors", T.StringType()),
    T.StructField("authors_parsed", T.ArrayType(T.ArrayType(T.StringType()))), T.StructField("categories", T.StringType()), T.StructField("journal-ref", T.StringType()), T.StructField("journal_ref", T.StringType()), T.StructField("doi", T.StringType()),
    T.StructField("versions", T.ArrayType(T.StructType([T.StructField("version", T.StringType()), T.StructField("created", T.StringType())]))), T.StructField("update_date", T.StringType()),
])
CORRUPT = "_corrupt"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, mode: str = "strict") -> DataFrame:
    """JSON lines; blank lines are skipped. ``strict`` fails on a bad line, ``skip`` drops it, ``mark`` keeps it in _corrupt."""
    if mode == "mark":
        marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        return spark.read.schema(marked).option("columnNameOfCorruptRecord", CORRUPT).json(path, mode="PERMISSIVE")
    return spark.read.schema(schema).json(path, mode={"strict": "FAILFAST", "skip": "DROPMALFORMED"}[mode])


def read_json_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON array (or object) for the whole file, or JSON lines: decided by the first character."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(head) and head[0]["value"].lstrip().startswith("[")
    return spark.read.schema(schema).json(path, multiLine=array)


def scan_report(marked: DataFrame) -> DataFrame:
    """(scanned, kept, invalid) of rows read with mode ``mark``."""
    bad = F.col(CORRUPT).isNotNull()
    return marked.agg(F.count("*").alias("scanned"), F.count_if(~bad).alias("kept"), F.count_if(bad).alias("invalid"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True)


def read_folder(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All JSON-lines files of a folder with their file name as ``origin``."""
    return spark.read.schema(schema).json(f"{folder}/*.jsonl").withColumn("origin", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl", 1))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).csv(path, header=True)


def paper_from_raw(raw: DataFrame) -> DataFrame:
    """Paper records of raw metadata: names from their parts, else split at commas and "and"; venue from either spelling."""
    blank = lambda c: F.nullif(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), F.lit(""))
    part = lambda a, i: F.trim(F.coalesce(F.get(a, F.lit(i)), F.lit("")))
    named = F.transform("authors_parsed", lambda a: F.concat_ws(" ", F.filter(F.array(part(a, 1), part(a, 0), part(a, 2)), lambda x: x != "")))
    split = F.filter(F.transform(F.split("authors", r",|\s+and\s+"), lambda x: F.trim(x)), lambda x: x != "")
    return raw.select(
        F.col("id").alias("paper_id"), F.coalesce(blank(F.col("title")), F.lit("")).alias("title"), F.coalesce(blank(F.col("abstract")), F.lit("")).alias("abstract"), F.coalesce(F.filter(named, lambda x: x != ""), split).alias("authors"),
        F.filter(F.split(F.trim(F.coalesce("categories", F.lit(""))), r"\s+"), lambda x: x != "").alias("categories"), F.coalesce(F.try_to_date(F.regexp_extract(F.get("versions", F.lit(0))["created"], r"(\d{1,2} [A-Za-z]{3} \d{4})", 1), "d MMM yyyy").cast("string"), F.col("update_date")).alias("published_date"),
        F.coalesce(blank(F.col("`journal-ref`")), blank(F.col("journal_ref"))).alias("venue"), blank(F.col("doi")).alias("doi"), F.concat(F.lit("https://arxiv.org/abs/"), F.col("id")).alias("url"),
    )


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """(rows, digest): a digest of all rows that does not depend on their order, for index validity and manifests."""
    row = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return df.where(F.col(key).isNotNull()).agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))
