"""Sections, bullet items and result fields of Markdown and JSON answers.

Everything but the search for a balanced JSON object is built from array functions inside one row, so no line is
shuffled. Null and empty texts have no sections; a text without headings has none either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import python as Y
from corpuslane.functions import text as X

ATX, BOLD = r"^#{1,6}\s+\S", r"^\*\*(.+)\*\*\s*:?$"
MOST_ITEMS, ITEM_CHARS = 8, 1000
FAILED = "No structured answer could be read."


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def text_lines(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")


def headings(lines: Column) -> Column:
    """(at, level, title) of every ``#`` heading and of every line that is all bold, which counts as level 2."""

    def mark(line, i):
        t = _strip(line)
        level = F.when(t.rlike(ATX), F.length(F.regexp_extract(t, "^(#{1,6})", 1))).when(t.rlike(BOLD), 2)
        title = F.regexp_replace(F.regexp_replace(t, r"^#{1,6}\s+|\s*#*$", ""), "[*_`]", "")
        return F.struct(i.alias("at"), level.alias("level"), F.lower(F.regexp_replace(title, r"^\s+|[\s:]+$", "")).alias("title"))

    return F.filter(F.transform(lines, mark), lambda h: h["level"].isNotNull())


def sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, level, title, body): body runs to the next heading of the same or a higher level."""
    rows = df.select(key, text_lines(F.col(text)).alias("_lines")).withColumn("_heads", headings(F.col("_lines")))

    def body(h):
        later = F.filter(F.col("_heads"), lambda o: (o["at"] > h["at"]) & (o["level"] <= h["level"]))
        stop = F.coalesce(F.array_min(F.transform(later, lambda o: o["at"])), F.size("_lines"))
        return F.struct((h["at"] + 1).alias("line_no"), h["level"].alias("level"), h["title"].alias("title"), F.slice(F.col("_lines"), h["at"] + 2, stop - h["at"] - 1).alias("body"))

    return rows.select(key, F.inline(F.transform("_heads", body)))


def bullets(body: Column) -> Column:
    """Items of the lines that start with a hyphen or an asterisk."""
    stripped = F.filter(F.transform(body, _strip), lambda t: t.rlike("^[-*]") & (F.length(t) > 2))
    return F.transform(stripped, lambda t: X.clean_text(F.regexp_replace(t, r"^[-* ]+", "")))


def items(body: Column, label: str) -> Column:
    """The first bullets of a section; without bullets its text behind a label; nothing for an empty one."""
    found = F.transform(F.slice(bullets(body), 1, MOST_ITEMS), lambda t: F.substring(t, 1, ITEM_CHARS))
    whole = X.clean_text(F.array_join(body, " "))
    alone = F.array(F.concat(F.lit(label + ": "), F.substring(whole, 1, ITEM_CHARS)))
    return F.when(F.size(found) > 0, found).when(whole != "", alone).otherwise(F.array().cast("array<string>"))


# Words in the headings of findings and of gaps.
FINDINGS = ("finding", "contribution", "result", "strength")
GAPS = ("gap", "limitation", "weakness", "future")


def parse_answers(df: DataFrame, key: str) -> DataFrame:
    """(key, origin, summary, key_findings, research_gaps) of rows (key, text, error), distinct by key.

    The earliest balanced JSON object counts first (origin json); then the first section about findings and the first
    about gaps (markdown); otherwise, and for every row with an error or a blank text, the row failed, with the error
    in its summary.
    """
    strings = "array<string>"
    rows = df.select(key, "text", "error").withColumn("_json", F.try_parse_json(Y.first_json_object("text")))
    field = lambda name, kind: F.try_variant_get("_json", f"$.{name}", kind)
    lines = F.coalesce(text_lines(F.col("text")), F.array().cast(strings))
    rows = rows.withColumn("_lines", lines).withColumn("_heads", headings(F.col("_lines")))

    def section(words: tuple[str, ...], label: str) -> Column:
        head = F.get(F.filter("_heads", lambda h: h["title"].rlike("|".join(words))), F.lit(0))
        later = F.filter(F.col("_heads"), lambda o: (o["at"] > head["at"]) & (o["level"] <= head["level"]))
        stop = F.coalesce(F.array_min(F.transform(later, lambda o: o["at"])), F.size("_lines"))
        none = F.array().cast(strings)
        return F.when(head.isNull(), none).otherwise(items(F.slice(F.col("_lines"), head["at"] + 2, stop - head["at"] - 1), label))

    rows = rows.withColumn("_found", section(FINDINGS, "Findings")).withColumn("_gaps", section(GAPS, "Gaps"))
    blank = _strip(F.coalesce("text", F.lit(""))) == ""
    parts = F.struct(
        F.when(F.col("error").isNotNull() | blank, "failed").when(F.col("_json").isNotNull(), "json").when((F.size("_found") > 0) | (F.size("_gaps") > 0), "markdown").otherwise("failed").alias("origin")
    )
    rows = rows.withColumn("origin", parts["origin"])
    empty = F.array().cast(strings)
    pick = lambda a, b: F.when(F.col("origin") == "json", F.coalesce(a, empty)).when(F.col("origin") == "markdown", b).otherwise(empty)
    rows = rows.withColumn("key_findings", pick(field("key_findings", strings), F.col("_found"))).withColumn("research_gaps", pick(field("research_gaps", strings), F.col("_gaps")))
    summary = F.when(F.col("origin") == "json", F.nullif(F.trim(field("summary", "string")), F.lit("")))
    failed = F.when(F.col("error").isNotNull(), F.concat(F.lit("Synthesis failed: "), "error")).otherwise(F.lit(FAILED))
    first = F.get("key_findings", F.lit(0))
    return rows.select(key, "origin", F.when(F.col("origin") == "failed", failed).otherwise(F.coalesce(summary, first, F.lit(FAILED))).alias("summary"), "key_findings", "research_gaps").dropDuplicates([key])
