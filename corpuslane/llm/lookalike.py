"""Problem 8: one consistent form for texts that look the same but are stored with different characters.

Texts made only of settled characters (a quick check by one regular expression) are their own form. Of the others,
the words with unsettled characters are exploded into positioned code points, which meet a broadcast decomposition
table and a broadcast look-alike table; pieces are put back in order, combining marks ordered by class and composed,
and words and text rebuilt. Both tables follow from Unicode data or are short fixed lists, so their size is bounded.

What becomes one form: canonical equivalents, full-width and half-width forms, Latin ligatures, zero-width and
soft-hyphen characters (dropped), blanks of any width (a space), hyphens U+2010 and U+2011, and letters of other
scripts drawn like Latin ones; conjoining Hangul letters become syllables. Everything else, such as case, superscripts or quotes, stays different.

Defined results for odd input: null text has a null form; empty text the empty form; texts without a visible
character are in no pair; Hangul letters that make no syllable stay as stored; repeated rows count once.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters without width.
DROPPED = "­᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿‪‫‬‭‮⁦⁧⁨⁩"
# Blanks shown as a space.
BLANKS = "               　"
HYPHENS = "‐‑"
# Letters of other scripts and the Latin letters they are drawn like.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԁ": "D", "Ԛ": "Q", "Ԝ": "W", "Ԍ": "G", "Ӏ": "I",
    "а": "a", "е": "e", "ѕ": "s", "і": "i", "ј": "j", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "ԁ": "d", "ԛ": "q",
    "ԝ": "w", "һ": "h", "ӏ": "l", "ѵ": "v", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T",
    "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J",
    "Տ": "S", "Օ": "O", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ո": "n", "Լ": "L", "ɡ": "g", "ɩ": "i",
}
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
MARK_BASE = 1_000


def _decompositions() -> dict[str, str]:
    """Every character whose stored form changes before look-alikes: full canonical, width and ligature forms."""
    table = {c: "" for c in DROPPED} | {c: " " for c in BLANKS} | {c: "-" for c in HYPHENS} | LIGATURES
    for cp in range(0x80, 0x30000):
        if 0xD800 <= cp <= 0xDFFF or 0xAC00 <= cp <= 0xD7A3:
            continue
        ch = chr(cp)
        if ch in table:
            continue
        kind = unicodedata.decomposition(ch).split(" ")[0]
        full = unicodedata.normalize("NFKD" if kind in ("<wide>", "<narrow>") else "NFD", ch)
        if full != ch:
            table[ch] = full
    return table


def _composition_pairs(decompositions: dict[str, str]) -> dict[str, str]:
    """Pairs (character, mark) that compose into one character."""
    pairs = {}
    for ch in decompositions:
        parts = unicodedata.decomposition(ch)
        if parts and not parts.startswith("<") and len(parts.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            first, second = (chr(int(p, 16)) for p in parts.split())
            pairs[first + second] = ch
    return pairs


def _unsettled_class(decompositions: dict[str, str]) -> str:
    """A regular expression class of characters whose presence means that a text may change."""
    odd = {ord(c) for c in LOOKALIKES} | set(range(0x1160, 0x1200))  # vowels and finals join what stands before them
    for ch, full in decompositions.items():
        settled = unicodedata.normalize("NFC", ch) == ch and not any(c in LOOKALIKES for c in full) and unicodedata.normalize("NFC", full) == ch
        if not settled:
            odd.add(ord(ch))
    ranges: list[list[int]] = []
    for cp in sorted(odd):
        if ranges and cp == ranges[-1][1] + 1:
            ranges[-1][1] = cp
        else:
            ranges.append([cp, cp])
    # Characters below the first marks are settled but for two blanks; they are told apart before the many ranges.
    quick = "[^\\x{00}-\\x{9f}\\x{a1}-\\x{ac}\\x{ae}-\\x{ff}]"
    return f"[{quick}&&[\\p{{M}}" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]]"


class Tables:
    """The mappings, made once on the driver from Unicode data."""

    def __init__(self) -> None:
        self.decompositions = _decompositions()
        self.pairs = _composition_pairs(self.decompositions)
        self.unsettled = _unsettled_class(self.decompositions)
        self.classes = {chr(cp): c for cp in range(0x300, 0x20000) if (c := unicodedata.combining(chr(cp))) not in (0, 230)}
        self.by_mark: dict[str, dict[str, str]] = {}
        for both, made in self.pairs.items():
            self.by_mark.setdefault(both[1], {})[both[0]] = made


def _mark_class(mark: Column, tables: Tables) -> Column:
    """Combining class of a mark: one test a class, as most classes have many marks."""
    by_class: dict[int, str] = {}
    for ch, c in tables.classes.items():
        by_class[c] = by_class.get(c, "") + ch
    return F.coalesce(*[F.when(F.contains(F.lit(chars), mark), F.lit(c)) for c, chars in by_class.items()], F.lit(230))


def _joined(base: Column, mark: Column, tables: Tables) -> Column:
    """The character that a base and a mark compose into; the base itself if there is none."""
    out = base
    for m, pairs in tables.by_mark.items():
        out = F.when(mark == m, F.translate(base, "".join(pairs), "".join(pairs.values()))).otherwise(out)
    return out


def _compose(cluster: Column, tables: Tables) -> Column:
    """One base with its marks: marks in class order, then composed where no mark of the same class stands between."""
    chars = F.split(cluster, "")
    marks = F.transform(F.slice(chars, 2, F.greatest(F.size(chars) - 1, F.lit(0))), lambda m, i: F.struct(_mark_class(m, tables).alias("c"), i.alias("i"), m.alias("m")))
    start = F.struct(F.get(chars, F.lit(0)).alias("base"), F.lit("").alias("kept"), F.lit(0).alias("last"))

    def step(state: Column, mark: Column) -> Column:
        made = _joined(state["base"], mark["m"], tables)
        joins = (made != state["base"]) & (state["last"] < mark["c"])
        return F.struct(
            F.when(joins, made).otherwise(state["base"]).alias("base"), F.when(joins, state["kept"]).otherwise(F.concat(state["kept"], mark["m"])).alias("kept"), F.when(joins, state["last"]).otherwise(mark["c"]).alias("last")
        )

    return F.aggregate(F.array_sort(marks), start, step, lambda s: F.concat(s["base"], s["kept"]))


JAMO = r"[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]"


def _syllable(jamo: Column) -> Column:
    """The Hangul syllable of a leading letter, a vowel and perhaps a final, or of an open syllable and a final."""
    code = lambda i: F.ascii(F.substr(jamo, F.lit(i), F.lit(1)))
    last = F.when(F.length(jamo) == 3, code(3) - 0x11A7).otherwise(0)
    whole = F.when(code(1) >= 0xAC00, code(1) + code(2) - 0x11A7).otherwise(0xAC00 + ((code(1) - 0x1100) * 21 + code(2) - 0x1161) * 28 + last)
    # A closed syllable takes no further final.
    closed = (code(1) >= 0xAC00) & ((code(1) - 0xAC00) % 28 != 0)
    return F.when(closed, jamo).otherwise(F.decode(F.unhex(F.lpad(F.hex(whole), 4, "0")), "UTF-16BE"))


def one_form(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, form): every distinct (key, text) of ``df`` with its consistent form."""
    spark: SparkSession = df.sparkSession
    tables = Tables()
    decomposition = spark.createDataFrame([(k, v) for k, v in tables.decompositions.items()], "ch string, full string")
    lookalike = spark.createDataFrame(list(LOOKALIKES.items()), "piece string, latin string")

    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t")).distinct()
    odd = F.coalesce(F.col("_t").rlike(tables.unsettled), F.lit(False))
    settled = rows.where(~odd).select("_k", "_t", F.col("_t").alias("form"))

    # Words and blanks in turn; only words with unsettled characters are taken apart.
    words = F.posexplode(F.regexp_extract_all("_t", F.lit(r"([ \t\r\n]+|[^ \t\r\n]+)"), 1))
    parted = rows.where(odd).withColumn("_s", F.md5("_t")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_k", "_s").select("_k", "_s", "_t", words.alias("_w", "_word"))
    parted = parted.withColumn("_odd", F.col("_word").rlike(tables.unsettled))
    points = parted.select("_k", "_s", "_w", F.when(F.col("_w") == 0, F.col("_t")).alias("_t"), F.posexplode(F.when(F.col("_odd"), F.split("_word", "")).otherwise(F.array("_word"))).alias("_p", "ch"))
    full = points.join(F.broadcast(decomposition), "ch", "left").withColumn("full", F.coalesce("full", "ch"))
    pieces = full.select("_k", "_s", "_w", "_t", "_p", F.posexplode(F.when(F.length("ch") > 2, F.array("full")).otherwise(F.split("full", ""))).alias("_i", "piece"))
    mapped = pieces.join(F.broadcast(lookalike), "piece", "left").select("_k", "_s", "_w", "_t", "_p", "_i", F.coalesce("latin", "piece").alias("piece"))
    # A word is put together from its code points, then the text from its words; both stay in the task of their text.
    one_word = mapped.groupBy("_k", "_s", "_w").agg(F.array_sort(F.collect_list(F.struct("_p", "_i", "piece"))).alias("_all"), F.max("_t").alias("_t"))
    loose = F.array_join(F.transform("_all", lambda p: p["piece"]), "")
    # Runs without marks pass whole; a base with marks is composed.
    clusters = F.regexp_extract_all(loose, F.lit(rf"({JAMO}|(?:(?!{JAMO})\P{{M}}(?!\p{{M}}))+|\P{{M}}\p{{M}}+|\p{{M}}+)"), 1)
    form = F.array_join(F.transform(clusters, lambda c: F.when(c.rlike(r"\p{M}"), _compose(c, tables)).when(c.rlike(rf"^(?:{JAMO})$"), _syllable(c)).otherwise(c)), "")
    whole = F.when(loose.rlike(rf"\p{{M}}|{JAMO}"), form).otherwise(loose)
    rebuilt = one_word.select("_k", "_s", "_w", "_t", whole.alias("_word")).groupBy("_k", "_s").agg(F.array_sort(F.collect_list(F.struct("_w", "_word"))).alias("_all"), F.max("_t").alias("_t"))
    changed = rebuilt.select("_k", "_t", F.array_join(F.transform("_all", lambda p: p["_word"]), "").alias("form"))
    return settled.unionByName(changed).select(F.col("_k").alias(key), F.col("_t").alias(text), "form")


def form_members(forms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form_id, spelling, spellings): each visible text's form and stored spelling as digests, and how many spellings the form has.

    One row a document, however many copies a form has; :func:`same_looking_pairs` expands them.
    """
    visible = F.length(F.regexp_replace("form", r"[\s\p{Z}\p{Cf}]", "")) > 0
    docs = forms.where(visible & F.col(key).isNotNull()).select(F.col(key), F.sha2("form", 256).alias("form_id"), F.sha2(F.col(text), 256).alias("spelling")).distinct()
    several = docs.select("form_id", "spelling").distinct().groupBy("form_id").agg(F.count("*").alias("spellings")).where("spellings > 1")
    return docs.join(several, "form_id").select(key, "form_id", "spelling", "spellings")


def same_looking_pairs(forms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b): documents of one form stored with different characters.

    Pairs are made between distinct texts first and only then between documents, so copies of one text, however
    many, are never compared with each other.
    """
    docs = form_members(forms, key, text).select(F.col(key).alias("id"), F.col("form_id").alias("f"), F.col("spelling").alias("t"))
    variants = docs.select("f", "t").distinct()
    pairs = variants.select("f", F.col("t").alias("ta")).join(variants.select("f", F.col("t").alias("tb")), "f").where("ta < tb")
    a, b = docs.select("f", F.col("t").alias("ta"), F.col("id").alias("a")), docs.select("f", F.col("t").alias("tb"), F.col("id").alias("b"))
    both = pairs.join(a, ["f", "ta"]).join(b, ["f", "tb"]).where("a <> b")
    return both.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()
