"""Structure of extracted papers: numbered headings, sections between them, abstracts, and entries of reference lists.

Lines are numbered inside their text; null and empty texts give no rows; equal rows count once where a result says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import rules as R

# What a year looks like, how entries begin, and what begins no entry.
YEAR = r"(?i)(?<!\d)(?:18|19|20)\d{2}[a-z]?(?!\d)"
NO_START = r"^(?:In|Proceedings|International|Journal|Conference|University)\b"
SURNAME_INITIAL = r"^\p{Lu}[\p{L}'’\-]+,\s+\p{Lu}\.?(?:\s+\p{Lu}\.?)?"
ET_AL = r"(?i)^[^.!?]{1,120}\bet\s+al\."
NAMED = r"^\p{Lu}[\p{L}'’\-]+(?:\s+(?:\p{Lu}\.|\p{Lu}[\p{L}'’\-]+)){1,6}(?:,|\s+and\b|\s+et\s+al\.|\.\s+)"
MARKER = r"(?m)^\s*(?:\[\d{1,3}\]|\d{1,3}\.)\s+"
REFERENCES_KEPT = 200


def numbered_text(sections: Column) -> Column:
    """A paper's sections as one text with numbered headings, by name; sections that hold nothing are left out."""
    entries = F.array_sort(F.filter(F.map_entries(sections), lambda e: F.length(F.trim(F.coalesce(e["value"], F.lit("")))) > 0))
    titled = F.transform(entries, lambda e, i: F.concat((i + 1).cast("string"), F.lit(" "), F.initcap(F.replace(e["key"], F.lit("_"), F.lit(" "))), F.lit("\n"), e["value"]))
    return F.array_join(titled, "\n")


def heading_lines(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line, section, opens): every line; ``opens`` marks numbered headings, ``section`` what they open."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "line"))
    caption = F.lower("line").rlike(r"\b(figure|table|algorithm|appendix)\b") & ~F.col("line").rlike(r"^\d+\s+[A-Z]")
    opens = F.col("line").rlike(R.HEADING) & ~caption
    return lines.select(key, (F.col("_i") + 1).cast("bigint").alias("line_no"), "line", F.when(opens, R.section_key(F.col("line"))).alias("section"), opens.alias("opens"))


def split_sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, section, body): the text under the headings of each section, parts of one section apart by an empty line.

    Lines before the first heading and under unknown headings, and abstracts, are left out. A text is one group.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    blocks = heading_lines(df, key, text).withColumn("_b", F.sum(F.col("opens").cast("int")).over(order)).where("_b > 0")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("opens"), F.struct("line_no", "line")))), lambda x: x["line"]), "\n")
    parts = blocks.groupBy(key, "_b").agg(F.max("section").alias("section"), F.trim(joined).alias("_body"))
    kept = parts.where("section is not null and section <> 'abstract' and _body <> ''")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "_body"))), lambda x: x["_body"]), "\n\n")
    return kept.groupBy(key, "section").agg(body.alias("body"))


def abstract_of(text: Column) -> Column:
    """What follows the word "abstract" up to a numbered heading or the end, cut at what charts leave behind; "" without it."""
    found = F.regexp_extract(text, r"(?is)\babstract\b\s*(.+?)(?=\n\s*\d+\s+(?-i:[A-Z])|\z)", 1)
    return F.trim(F.get(F.split(F.trim(F.regexp_replace(found, r"\s+", " ")), r"\b0\.0\b|\bFigure\b", 2), F.lit(0)))


def starts_entry(line: Column) -> Column:
    """Whether a line begins like the authors of a reference."""
    prefix = F.get(F.split(line, r"\.\s+(?=\p{Lu})", 2), F.lit(0))
    authors = line.rlike(SURNAME_INITIAL) | line.rlike(ET_AL) | line.rlike(NAMED) | prefix.rlike(r"(?i)\b(?:and|&)\b") | (F.length(F.regexp_replace(line, "[^,]", "")) >= 2)
    return F.coalesce(line.rlike(r"^\p{Lu}") & ~line.rlike(NO_START) & authors, F.lit(False))


def tidy_entry(entry: Column) -> Column:
    trimmed = F.regexp_replace(F.regexp_replace(entry, r"\s+", " "), r"^[ ,;.]+|[ ,;.]+$", "")
    return F.trim(F.regexp_replace(trimmed, r"^(?:\[\d{1,3}\]|\d{1,3}\.)\s+", ""))


def is_entry(entry: Column) -> Column:
    """At least 20 characters with a letter, and no heading of the list."""
    return (F.length(entry) >= 20) & ~F.lower(entry).isin("references", "bibliography", "works cited") & entry.rlike("[A-Za-z]")


def entry_score(entry: Column) -> Column:
    """How much an entry looks like one whole citation."""
    n, years, author = F.length(entry), F.regexp_count(entry, F.lit(YEAR)), starts_entry(entry)
    when = lambda c, v: F.when(c, v).otherwise(F.lit(0.0))
    return (
        when(author, 2.0) + when(years > 0, 2.0) + when(n.between(40, 450), 1.0) - when(n < 30, 4.0) - when(n > 600, 3.0 + (n - 600) / 200) - when(years > 2, (years - 2) * 2.0) - when(~author | (years == 0), 2.0)
    )


def entries_by_author(tail: Column) -> Column:
    """Entries of a list without numbers: a line that begins like authors opens the next one once the last has a year."""
    lines = F.filter(F.transform(F.split(tail, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: (x != "") & ~x.rlike(r"^\d{1,3}$"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, line: Column) -> Column:
        new = (state["open"] != "") & state["open"].rlike(YEAR) & starts_entry(line)
        return F.struct(F.when(new, F.array_append(state["done"], state["open"])).otherwise(state["done"]).alias("done"), F.when(new | (state["open"] == ""), line).otherwise(F.concat(state["open"], F.lit(" "), line)).alias("open"))

    folded = F.aggregate(lines, start, step, lambda s: F.array_append(s["done"], s["open"]))
    return F.filter(F.transform(folded, tidy_entry), is_entry)


def entries_by_number(tail: Column) -> Column:
    return F.filter(F.transform(F.split(tail, MARKER), tidy_entry), is_entry)


def entries_by_line(tail: Column) -> Column:
    return F.filter(F.transform(F.split(tail, "\n"), tidy_entry), is_entry)


def split_references(tail: Column) -> Column:
    """Distinct entries of a reference list: by numbers where it has two or more, else by authors or by line, whichever
    scores better in all; at most REFERENCES_KEPT, which is the rule of the operator. Null and empty lists give none."""
    total = lambda a: F.when(F.size(a) > 0, F.aggregate(F.transform(a, entry_score), F.lit(0.0), lambda x, y: x + y)).otherwise(F.lit(float("-inf")))
    numbered = F.regexp_count(tail, F.lit(MARKER)) >= 2
    by_author, by_line = entries_by_author(tail), entries_by_line(tail)
    best = F.when(numbered, entries_by_number(tail)).when(total(by_author) >= total(by_line), by_author).otherwise(by_line)
    return F.coalesce(F.slice(F.array_distinct(best), 1, REFERENCES_KEPT), F.array().cast("array<string>"))
