"""Problem 2: several values packed in one field become one value a row, with their place.

Fields come from many sources, each with its own manner, and no column names the source. A field's *layout* stands
for it: which separators occur outside quotes, whether it is a quoted list, and what the comma-separated parts look
like. For each layout every way of splitting is scored over all its rows by how regular the pieces are (the share
that look like one whole value) and how steady their number is; the best way splits the rows of that layout.

Defined results for odd input: null and blank fields, empty lists and fields made only of separators give no row;
empty pieces don't count in ``pos``; a quote without its partner is an ordinary character; pieces that no way of
splitting makes regular are split by the way that leaves the most regular ones; repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.runtime import cut_lineage, spread

# Separators outside quotes are marked by control characters while ways of splitting are compared.
MARKS = {";": "\u0001", "|": "\u0002", "\n": "\u0003", "\t": "\u0004", "/": "\u0005", " and ": "\u0006", "&": "\u0007", ",": "\u000e"}
STRONG, WORD, COMMA, PAIR = "\u0001\u0002\u0003\u0004\u0005", "\u0006\u0007", "\u000e", "\u000f"
BLANK = r"[\s  -  　]"

NAME = r"\p{Lu}[\p{L}\p{M}'’\-]*\p{L}"
PARTICLE = r"(?:(?:van|von|der|den|de|del|della|di|da|dos|du|la|le|ter|ten|bin|al|el)\s+)"
INITIALS = r"(?:\p{Lu}\.?[\s\-]?)+"
SUFFIX = r"(?:,?\s+(?:Jr|Sr|II|III|IV)\.?)"
SURNAME = rf"{PARTICLE}*{NAME}(?:\s+{NAME})?"
GIVEN = rf"(?:{NAME}|\p{{Lu}}\.)(?:\s+(?:{NAME}|\p{{Lu}}\.?))*"
DIRECT = rf"(?:{NAME}|(?:\p{{Lu}}\.\s?)+)(?:\s+(?:\"+{NAME}\"+|{NAME}|\p{{Lu}}\.?))*\s+{PARTICLE}*{NAME}{SUFFIX}?"
INVERTED = rf"{SURNAME},\s*(?:{INITIALS}|{GIVEN}){SUFFIX}?"
ORG = r"(?:The\s+)?\p{Lu}[\p{L}\p{M}'’\-]+(?:\s+(?:of|for|and|the|on|in|\p{Lu}[\p{L}\p{M}'’\-]+))+"
PERSON = rf"^(?:{DIRECT}|{INVERTED}|{ORG}|{NAME})$"
WHOLE = rf"^(?:{DIRECT}|{INVERTED}|{ORG})$"
CODE = r"[A-Za-z]+(?:-[A-Za-z]+)*\.[A-Za-z]+(?:-[A-Za-z]+)*|\d\d[A-Z-][\dx][\dx]"
LABEL = r"[^()\u0001-\u0008]+\([^()]+\)"
WHOLE_CODE = rf"^(?:{CODE}|{LABEL})$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def _mark(c: Column) -> Column:
    """Marks separators in text that stands outside quotes."""
    c = F.regexp_replace(c, r"\r?\n|\r", MARKS["\n"])
    c = F.regexp_replace(c, r"(?:,|;)?[  ]+(?:and|und|et|y)[  ]+(?=\p{Lu}|\p{Ll}+\s+\p{Lu}|\"|$)", MARKS[" and "])
    c = F.regexp_replace(c, r",?\s*&", MARKS["&"])
    return F.translate(c, ";|\t/,", "".join(MARKS[x] for x in ";|\t/,"))


def _unmark(c: Column, kept: str) -> Column:
    back = {mark: text for text, mark in MARKS.items()}
    for mark in kept:
        c = F.replace(c, F.lit(mark), F.lit({" and ": " and ", "&": " &"}.get(back[mark], back[mark])))
    return c


def _outside_marked(value: Column) -> Column:
    """Marks the separators of a field except inside double quotes (``""`` inside quotes is an escaped quote)."""
    parts = F.split(F.regexp_replace(value, r'\\"', '""'), '"')
    marked = F.transform(parts, lambda p, i: F.when(i % 2 == 0, _mark(p)).otherwise(p))
    joined = F.array_join(marked, '"')
    return F.when(F.size(parts) % 2 == 1, joined).otherwise(_mark(value))


def _clean_piece(c: Column) -> Column:
    """Without outer blanks and enclosing quotes; doubled quotes inside them become one."""
    c = _strip(c)
    quoted = c.rlike(r'^"(?s:.*)"$') & (F.length(c) > 1)
    return F.when(quoted, _strip(F.replace(F.substr(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"')))).otherwise(c)


def _pieces(marked: Column, marks: str, paired: bool, field: str) -> Column:
    kept = "".join(m for m in MARKS.values() if m not in marks and not (paired and m == COMMA))
    base = F.split(_unmark(marked, kept), f"[{marks}]") if marks else F.array(_unmark(marked, kept))
    if field == "authors" and COMMA in marks:
        # A suffix belongs to the name before its comma.
        suffixed = F.regexp_replace(_unmark(marked, kept), rf"{COMMA}(\s*(?:Jr|Sr|II|III|IV)\b\.?)", r",$1")
        base = F.split(suffixed, f"[{marks}]")
    if paired:
        # Every second comma separates: "Surname, Given, Surname, Given".
        flat = F.regexp_replace(_unmark(marked, kept), rf"{COMMA}(\s*(?:Jr|Sr|II|III|IV)\b\.?)", r"$1")
        flat = F.regexp_replace(flat, rf"([^{COMMA}{marks}]+){COMMA}([^{COMMA}{marks}]+)(?:{COMMA}|(?=[{marks}])|$)", rf"$1,$2{PAIR}")
        base = F.split(flat, f"[{marks}{PAIR}{COMMA}]")
    cleaned = F.transform(base, _clean_piece)
    return F.filter(cleaned, lambda p: p.rlike(r"[\p{L}\p{N}]"))


def _ways(marked: Column, field: str) -> Column:
    """The ways of splitting a field, from the fewest pieces to the most."""
    ways = [("whole", "", False), ("strong", STRONG, False)]
    if field == "authors":
        ways += [("words", STRONG + WORD, False), ("commas", STRONG + WORD + COMMA, False), ("comma_pairs", STRONG + WORD, True)]
    else:
        ways += [("commas", STRONG + COMMA, False)]
    made = [F.struct(F.lit(name).alias("way"), _pieces(marked, marks, paired, field).alias("pieces")) for name, marks, paired in ways]
    if field == "categories":
        spaced = F.regexp_replace(marked, rf"{BLANK}+", MARKS[";"])
        made.append(F.struct(F.lit("blanks").alias("way"), _pieces(spaced, STRONG + COMMA, False, field).alias("pieces")))
    return F.array(*made)


def _list_items(value: Column) -> Column:
    """Items of a bracketed list with single or double quotes (escapes resolved); null for anything else."""
    options = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    parsed = F.from_json(F.when(value.rlike(r"^\[(?s:.*)\]$"), value), "array<string>", options)
    return F.filter(F.transform(parsed, _strip), lambda p: p.isNotNull() & (p != ""))


def _comma_shapes(marked: Column) -> Column:
    """The kinds of comma-separated parts: whole names, surnames, given names, initials, suffixes, others."""
    part = lambda p: (
        F.when(p == "", "_").when(p.rlike(rf"^{INITIALS}$"), "i").when(p.rlike(r"^(?:Jr|Sr|II|III|IV)\.?$"), "x")
        .when(p.rlike(rf"^{PARTICLE}+{NAME}$"), "s").when(p.rlike(rf"^{NAME}$"), "w").when(p.rlike(rf"^{NAME}(?:\s+\p{{Lu}}\.?)+$"), "g")
        .when(p.rlike(rf"^{DIRECT}$"), "F").when(p.rlike(rf"^(?:{CODE})$"), "c").when(p.rlike(rf"^{LABEL}$"), "l").otherwise("o")
    )
    kinds = F.transform(F.split(marked, rf"[{STRONG}{WORD}{COMMA}]"), lambda p: part(_clean_piece(p)))
    return F.concat(F.array_join(F.array_sort(F.array_distinct(kinds)), ""), F.least(F.size(kinds), F.lit(3)).cast("string"))


def _layout(value: Column, marked: Column) -> Column:
    present = F.concat(*[F.when(F.contains(marked, F.lit(m)), F.lit(name)).otherwise(F.lit("")) for name, m in zip("sbntzaec", MARKS.values())])
    quoted = F.when(F.contains(value, F.lit('"')), "q").otherwise("")
    return F.concat_ws("|", present, quoted, _comma_shapes(marked))


#: Share of a way's score that follows the steadiness of its piece counts.
STEADY_WEIGHT = 0.2


def packed_fields(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field_name, raw) of the fields that hold something; repeated rows count once."""
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), _strip(F.col(f)).alias("raw")) for f in fields]))
    return df.select(F.col(key), stacked.alias("_f")).select(key, "_f.field_name", "_f.raw").where("raw <> ''").distinct()


def _prepared(df: DataFrame, key: str, kinds: dict[str, str]) -> DataFrame:
    """Fields with what splitting needs: list items, or the layout and the pieces by every way."""
    rows = packed_fields(df, key, tuple(kinds))
    kind = F.coalesce(*[F.when(F.col("field_name") == name, F.lit(k)) for name, k in kinds.items()])
    rows = rows.withColumn("kind", kind).withColumn("items", _list_items(F.col("raw")))
    bare = F.when(F.col("raw").rlike(r"^\[(?s:.*)\]$"), F.substr(F.col("raw"), F.lit(2), F.length("raw") - 2)).otherwise(F.col("raw"))
    rows = rows.withColumn("marked", F.when(F.col("items").isNull(), _outside_marked(bare)))
    ways = F.when(F.col("kind") == "authors", _ways(F.col("marked"), "authors")).otherwise(_ways(F.col("marked"), "categories"))
    return rows.withColumn("layout", _layout(F.col("raw"), F.col("marked"))).withColumn("ways", F.when(F.col("items").isNull(), ways)).drop("marked")


def layout_scores(prepared: DataFrame) -> DataFrame:
    """Every way's score for every layout: (kind, layout, way, rows, regularity, steadiness, score)."""
    e = prepared.where(F.col("items").isNull()).select("kind", "layout", F.explode("ways").alias("w")).select("kind", "layout", "w.way", "w.pieces")
    good = lambda p: F.when(F.col("kind") == "authors", p.rlike(WHOLE)).otherwise(p.rlike(WHOLE_CODE))
    n = F.size("pieces")
    share = F.when(n > 0, F.size(F.filter("pieces", good)) / n).otherwise(0.0)
    # Steadiness counts for a fifth, so between ways that leave pieces about equally regular the steadier one wins.
    scored = e.groupBy("kind", "layout", "way").agg(F.count("*").alias("rows"), F.avg(share).alias("regularity"), F.avg(n).alias("mean"), F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("sd"))
    steady = 1 / (1 + F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0))
    return scored.withColumn("steadiness", steady).withColumn("score", F.round(F.col("regularity") * (1 - STEADY_WEIGHT + STEADY_WEIGHT * F.col("steadiness")), 6)).drop("mean", "sd")


WAY_ORDER = ("strong", "words", "commas", "comma_pairs", "blanks", "whole")


def best_ways(scores: DataFrame) -> DataFrame:
    """The winning way of each layout; ties go to the order of WAY_ORDER."""
    rank = F.array_position(F.array(*[F.lit(w) for w in WAY_ORDER]), F.col("way"))
    order = Window.partitionBy("kind", "layout").orderBy(F.desc("score"), rank)
    return scores.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("kind", "layout", "way")


def split_packed(df: DataFrame, key: str = "flat_id", kinds: dict[str, str] | None = None, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(key, field_name, pos, item): one row for each value of the packed fields of ``df``.

    ``kinds`` says for each field whether its values are people and organisations (``authors``) or subject codes
    (``categories``). Layouts are few whatever the input (bounded by the separators and part kinds that may occur).
    ``cut`` stores the fields split in every way, so they are split once for scoring and for the result.
    """
    prepared = cut(_prepared(spread(df, tasks_per_core=1), key, kinds or {"authors": "authors", "categories": "categories"}))
    chosen = best_ways(layout_scores(prepared))
    joined = prepared.join(chosen, ["kind", "layout"], "left")
    pieces = F.coalesce(F.col("items"), F.get(F.filter("ways", lambda w: w["way"] == F.col("way")), F.lit(0))["pieces"])
    out = joined.select(key, "field_name", F.posexplode(pieces).alias("p", "item"))
    return out.select(key, "field_name", (F.col("p") + 1).cast("int").alias("pos"), "item")
