"""Problem 4: repair text extracted from scanned pages.

Lines that stand at page edges are found first: page numbers by their form and by forming a sequence in a document,
running headers by fuzzy repetition at page edges (in the document, or in the corpus): lines whose letters differ by
few edits are one header. Being the head of the document's own title, an author line or numbers that run on support
headers that stand only once in their document. The rest are body lines. Words broken at line ends are joined with or without their hyphen,
whichever form the corpus vocabulary knows better; misread words are mapped to a much more frequent vocabulary word
from which common misreadings lead to them. The vocabulary is counted over all body lines of the corpus.

Defined results for odd input: null or empty sections and entries give nothing; repeated rows count once; a lone page number is accepted when the document has no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.runtime import cut_lineage

# Order of parts in a paper; other sections come between, references last.
PART_ORDER = ("abstract", "introduction", "related_work", "method", "results", "discussion", "limitations", "conclusion")
HYPHEN = r"[-‐‑¬­]"
#: How scanned letters are misread: what is read, and what was printed.
READ_FOR = {
    "c": ("e",), "1": ("i", "l"), "+": ("t",), "@": ("a",), "5": ("s",), "0": ("o",), "h": ("ti", "li"), "rn": ("m",), "ii": ("u",), "1i": ("u",), "i1": ("u",), "11": ("u", "ll"),
    "cl": ("d",), "c1": ("d",), "q": ("g",), "6": ("b",), "y": ("v",), "b": ("h",), "m": ("in",), "vv": ("w",), "w": ("vi",), "d": ("cl",), "8": ("b",), "9": ("g",), "3": ("e",), "|": ("l", "i"), "$": ("s",), "!": ("i", "l"), "f": ("t",), "nn": ("m",), "li": ("h",), "e": ("c",), "v": ("y",),
}
SYMBOLS = "+@015698|$!"
#: Longer words have so many possible printed forms that they are matched by their folded letters instead.
LONG_WORD = 40
#: Share of letters in which two lines of one running header may differ, and the bits of the filter of known words.
HEADER_EDITS, FILTER_BITS = 0.15, 1 << 24
#: A printed word must be so many times as frequent as its misread form.
FREQUENCY_RATIO = 8.0
#: A header line at a page edge must occur in so many documents to be known corpus-wide.
KNOWN_IN_DOCUMENTS = 3
#: ... and stand at an edge in this share of its occurrences.
EDGE_SHARE = 0.4
SHORTEST_WORD = 3

PAGE_NUMBER = r"(?iu)^\s*(?:[-–—~]\s*|\[\s*|\(\s*)?(?:page|pag\.|seite|p\.|pp\.|s\.)?\s*(\d{1,5})(?:\s*(?:/|of|von|de|sur)\s*\d{1,5})?\s*(?:[-–—~]|\]|\))?\s*$"


def _core(token: Column) -> Column:
    """A token without outer punctuation, in lower case."""
    return F.lower(F.regexp_replace(token, r"^[^\p{L}\p{N}@+|$]+|[^\p{L}\p{N}@+|$]+$", ""))


def _letters(c: Column) -> Column:
    """Letters only, with misreadings folded together, so that variants of a line have nearly the same key."""
    c = F.regexp_replace(c, r"\b\d+\b", "")
    c = F.translate(F.lower(c), "1|!05@+6c8q9", "lllosatbebgg")
    return F.regexp_replace(c, r"[^\p{L}]+", "")


def split_lines(papers: DataFrame) -> DataFrame:
    """(parsed_id, title, part_name, part_no, entry, ln, line): every line that holds something, in order."""
    order = F.array_position(F.array(*[F.lit(p) for p in PART_ORDER]), F.col("part_name"))
    keyed = papers.where(F.col("parsed_id").isNotNull())
    sections = keyed.select("parsed_id", "title", F.explode("sections").alias("part_name", "text")).withColumn("entry", F.lit(0)).withColumn("part_no", F.when(order > 0, order.cast("int")).otherwise(len(PART_ORDER) + 1))
    entries = keyed.select("parsed_id", "title", F.posexplode("reference_entries").alias("entry", "text")).withColumn("part_name", F.lit("references")).withColumn("part_no", F.lit(len(PART_ORDER) + 2))
    # All windows below are by paper and more, so one exchange by paper serves them and the removal of repeats.
    parts = sections.unionByName(entries).where(F.length("text") > 0).repartition("parsed_id").distinct()
    lines = parts.select("parsed_id", "title", "part_name", "part_no", "entry", F.posexplode(F.split("text", r"\r?\n")).alias("ln", "line"))
    return lines.withColumn("line", F.regexp_replace("line", r"^[\s ]+|[\s ]+$", "")).where("line <> ''")


def mark_edges(lines: DataFrame) -> DataFrame:
    """Adds ``noise`` (page_number, running_header or null) to the lines."""
    text = Window.partitionBy("parsed_id", "part_name", "entry").orderBy("ln")
    paper = Window.partitionBy("parsed_id").orderBy("part_no", "part_name", "entry", "ln")
    number = F.when(F.col("line").rlike(PAGE_NUMBER), F.regexp_extract("line", PAGE_NUMBER, 1).cast("int"))
    inside = F.regexp_extract("line", r"^(?:(\d{1,5})\s+\D.*|.*\D\s+(\d{1,5}))$", 1)
    outside = F.regexp_extract("line", r"^(?:(\d{1,5})\s+\D.*|.*\D\s+(\d{1,5}))$", 2)
    carried = F.coalesce(F.nullif(inside, F.lit("")), F.nullif(outside, F.lit(""))).cast("int")
    m = lines.withColumn("number", number).withColumn("carried", F.when(number.isNull(), carried))
    # Page numbers, and numbers carried by headers, go up by one from page to page.
    m = m.withColumn("shown", F.coalesce("number", "carried"))
    only_numbers = F.col("number").isNotNull()
    m = m.withColumn("_before", F.last("number", ignorenulls=True).over(paper.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first("number", ignorenulls=True).over(paper.rowsBetween(1, Window.unboundedFollowing)))
    m = m.withColumn("_numbers", F.count("number").over(Window.partitionBy("parsed_id")))
    near = lambda c: F.abs(F.col("number") - F.col(c)).between(0, 3)
    is_page = only_numbers & ((F.col("_numbers") == 1) | F.coalesce(near("_before"), F.lit(False)) | F.coalesce(near("_after"), F.lit(False)))
    m = m.withColumn("page", F.coalesce(is_page, F.lit(False)))

    key = F.regexp_replace(F.regexp_replace("line", r"^\d{1,5}\s+(?=\D)|\s+\d{1,5}$", ""), r"\s+", " ")
    m = m.withColumn("bare", F.when(~F.col("page"), key)).withColumn("key", _letters(F.col("bare")))
    # Not the fixed shape of a sentence, so a line of text that happens to repeat is no header by itself.
    beside = F.coalesce(F.lag("page").over(text), F.lit(False)) | F.coalesce(F.lead("page").over(text), F.lit(False))
    title_key = _letters(F.regexp_replace("title", r"\s+", " "))
    head_key = _letters(F.element_at(F.split("bare", r"\s+\|\s+"), 1))
    m = m.withColumn("_head", head_key).withColumn("_title", title_key)
    # A line longer than the title by more than the edits allowed is not its head.
    may = (F.length("_head") >= 12) & (F.length("_head") * (1 - HEADER_EDITS) <= F.length("_title"))
    as_title = F.when(may, F.levenshtein("_head", F.substr(F.col("_title"), F.lit(1), F.length("_head"))) <= F.length("_head") * HEADER_EDITS)
    et_al = F.col("bare").rlike(r"(?iu)^(?:\p{L}+\.?\s+)*[\p{L}'’\-]+\s+[ec]t\s+[a@][l1]\.?$")
    m = m.withColumn("as_title", F.coalesce(as_title, F.lit(False))).withColumn("et_al", F.coalesce(et_al, F.lit(False))).withColumn("beside", beside)
    # A number carried by a header runs with those of other lines of the same key.
    twin = Window.partitionBy("parsed_id", "key")
    spread = F.max("carried").over(twin) - F.min("carried").over(twin)
    m = m.withColumn("_twins", F.count("*").over(twin)).withColumn("_spread", spread)
    numbered = F.col("carried").isNotNull() & F.col("_spread").between(1, 4 * F.col("_twins"))
    # A body line is filled: the next word would not have gone on it. Lines at page edges stand alone.
    width = F.max(F.when(~F.col("page"), F.length("line"))).over(Window.partitionBy("parsed_id", "part_name"))
    next_word = F.element_at(F.split(F.lead("line").over(text), r"\s+"), 1)
    room = F.length("line") + 1 + F.coalesce(F.length(next_word), F.lit(0)) <= width
    alone = F.col("key").isNotNull() & (F.length("key") >= 4) & F.coalesce(room, F.lit(False)) & ~F.col("line").rlike(rf"^\p{{Ll}}|\p{{Ll}}{HYPHEN}$")
    m = m.withColumn("alone", alone).withColumn("edge", F.coalesce(F.col("alone") & (F.col("beside") | numbered), F.lit(False)))
    # A footer ends one page and a header opens the next, so beside a page number their numbers differ by one.
    m = m.withColumn("_page_no", F.when(F.col("page"), F.col("number")))
    follows = (F.col("carried") - F.lag("_page_no").over(text) == 1) | (F.lead("_page_no").over(text) - F.col("carried") == 1)
    opens = ~F.col("line").rlike(rf"^\p{{Ll}}|\p{{L}}{HYPHEN}$") & (F.length("key") >= 4)
    m = m.withColumn("runs", F.coalesce(follows & opens, F.lit(False)))
    return m


def near_twins(marked: DataFrame) -> DataFrame:
    """(parsed_id, key, _near, _near_edges): how many lines of the paper have this key or nearly, and how many at an edge.

    Keys are counted first, so a header on a thousand pages is one row. Keys of a paper meet by equal pieces (their
    first, middle and last letters), and the edit distance decides; only keys seen at an edge look for neighbours.
    """
    # A line that fills its column is text, so only lines that stand alone are near twins.
    keys = marked.where((F.length("key") >= 4) & (F.col("alone") | F.col("edge"))).groupBy("parsed_id", "key").agg(F.count("*").alias("_n"), F.count_if("edge").alias("_e"))
    piece = F.greatest(F.lit(3), F.least(F.lit(8), F.floor(F.length("key") / 4))).cast("int")
    middle = F.floor(F.length("key") / 2).cast("int")
    parts = F.array(F.concat(F.lit("<"), F.substr(F.col("key"), F.lit(1), piece)), F.concat(F.lit(">"), F.substr(F.col("key"), -piece)), F.concat(F.lit("|"), F.substr(F.col("key"), middle - 1, piece)))
    cut = keys.withColumn("_part", F.explode(parts))
    a = cut.where("_e > 0").select("parsed_id", "_part", "key")
    b = cut.select("parsed_id", "_part", F.col("key").alias("_b"), "_n", "_e")
    most = F.ceil(F.greatest(F.length("key"), F.length("_b")) * HEADER_EDITS)
    near = a.join(b, ["parsed_id", "_part"]).where((F.abs(F.length("key") - F.length("_b")) <= most) & ((F.col("key") == F.col("_b")) | (F.levenshtein("key", "_b") <= most)))
    each = near.groupBy("parsed_id", "key", "_b").agg(F.max("_n").alias("_n"), F.max("_e").alias("_e"))
    return each.groupBy("parsed_id", "key").agg(F.sum("_n").alias("_near"), F.sum("_e").alias("_near_edges"))


def known_headers(marked: DataFrame) -> DataFrame:
    """Keys of lines that mostly stand at page edges, in several documents: journal lines and notices."""
    per = marked.where("length(key) >= 8").groupBy("key").agg(F.count_distinct(F.when(F.col("edge"), F.col("parsed_id"))).alias("docs"), F.avg(F.col("edge").cast("int")).alias("share"))
    return per.where((F.col("docs") >= KNOWN_IN_DOCUMENTS) & (F.col("share") >= EDGE_SHARE)).select("key", F.lit(True).alias("known"))


def find_edges(lines: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The lines with ``noise``: page_number, running_header or null for body lines; ``cut`` stores the marked lines, which are read four times."""
    m = cut(mark_edges(lines).select("parsed_id", "part_name", "entry", "ln", "line", "key", "alone", "edge", "page", "as_title", "et_al", "runs", "_twins"))
    m = m.join(known_headers(m), "key", "left").join(near_twins(m), ["parsed_id", "key"], "left")
    repeated = F.col("edge") & (F.col("_near_edges") >= 2) & (F.col("_near_edges") >= 0.8 * F.greatest("_near", "_twins"))
    header = F.col("as_title") | F.col("et_al") | (F.coalesce("known", F.lit(False)) & ~F.col("line").rlike(r"^\p{Ll}")) | repeated | F.col("runs")
    noise = F.when(F.col("page"), "page_number").when(header & F.col("key").isNotNull(), "running_header")
    return m.select("parsed_id", "part_name", "entry", "ln", "line", noise.alias("noise"))


def body_lines(edged: DataFrame) -> DataFrame:
    """Body lines with the broken word at their end: ``left`` and ``right`` pieces, and what follows them."""
    text = Window.partitionBy("parsed_id", "part_name", "entry").orderBy("ln")
    all_lines = edged.withColumn("_prev_noise", F.lag("noise").over(text)).withColumn("_prev_ln", F.lag("ln").over(text))
    body = all_lines.where("noise is null").withColumn("next", F.lead("line").over(text)).withColumn("prev", F.lag("line").over(text))
    breaks = lambda line, after: F.coalesce(line.rlike(rf"[\p{{L}}\p{{N}}@+]{HYPHEN}$") & after.rlike(r"^[\p{L}\p{N}@+]"), F.lit(False))
    body = body.withColumn("broken", breaks(F.col("line"), F.col("next"))).withColumn("continues", breaks(F.col("prev"), F.col("line")))
    tokens = F.split("line", r"\s+")
    left = F.regexp_replace(_core(F.regexp_replace(F.element_at(tokens, -1), rf"{HYPHEN}$", "")), r"[‐‑¬­]", "-")
    right = _core(F.element_at(F.split("next", r"\s+"), 1))
    inner = F.slice(tokens, F.when(F.col("continues"), 2).otherwise(1), F.greatest(F.size(tokens) - F.when(F.col("continues"), 1).otherwise(0) - F.when(F.col("broken"), 1).otherwise(0), F.lit(0)))
    paragraph = (F.col("ln") - F.col("_prev_ln") > 1) & F.col("_prev_noise").isNull()
    return body.select(
        "parsed_id", "part_name", "entry", "ln", "line", "broken", "continues", F.coalesce(paragraph, F.lit(False)).alias("paragraph"), inner.alias("inner"),
        F.when(F.col("broken"), left).alias("left"), F.when(F.col("broken"), right).alias("right"),
    )


def _words_of(body: DataFrame) -> DataFrame:
    words = F.transform("inner", _core)
    initial = F.transform(F.sequence(F.lit(1), F.greatest(F.size("inner") - 1, F.lit(1))), lambda i: F.when(F.get("inner", i - 1).rlike(r"^\p{Lu}$") & F.get("inner", i).rlike(r"^\p{Ll}{2,}"), F.concat(_core(F.get("inner", i - 1)), F.lit(" "), _core(F.get("inner", i)))))
    every = F.concat(words, F.filter(initial, lambda x: x.isNotNull()))
    return body.select("parsed_id", "part_name", F.explode(every).alias("word")).where(F.col("word").rlike(r"\p{L}"))


def vocabulary(words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(word, n): words seen whole, and the joined forms of broken ones (with n = 0 if never seen whole)."""
    seen = words.groupBy("word").agg(F.count("*").alias("n"))
    joined = pairs.select(F.explode(F.array(F.concat("left", "right"), F.concat_ws("-", "left", "right"))).alias("word")).distinct().withColumn("n", F.lit(0).cast("bigint"))
    return seen.unionByName(joined).groupBy("word").agg(F.sum("n").alias("n"))


def printed_forms(word: str) -> list[str]:
    """Words of which ``word`` may be a misreading: all symbols read back and up to two more letters changed."""
    if " " in word:
        return [word.replace(" ", "")]
    bases = [word]
    for s in SYMBOLS:
        if any(s in b for b in bases) and any(c.isalpha() for c in word):
            bases = [c for b in bases for c in ([b.replace(s, r) for r in READ_FOR[s]] if s in b else [b])]
    # With several symbols of two readings, each place may be read in its own way.
    found = set(bases) | {word}
    layer = set(found)
    for _ in range(2):
        after = set()
        for b in layer:
            for read, printed in READ_FOR.items():
                at = b.find(read)
                while at >= 0:
                    after.update(b[:at] + p + b[at + len(read) :] for p in printed)
                    at = b.find(read, at + 1)
        layer = after - found
        found |= after
    found.discard(word)
    return [w for w in found if not any(c in "@+|$!" for c in w)]


def folded(word: Column) -> Column:
    """A word with all letters that are misread for each other folded together, so every misreading has the key of its word."""
    for read, printed in (("1i|i1|11|ii", "u"), ("rn|nn|in", "m"), ("cl|c1", "d"), ("vv|vi", "w"), ("li|ti", "h")):
        word = F.regexp_replace(word, read, printed)
    return F.translate(word, "c31|!i+f@5$0q9y68b", "eellllttassoggvhhh")


def known_word_bits(strong: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits in which each word of ``strong`` sets one; as bounded, it goes along with the tasks."""
    at = F.pmod(F.xxhash64("printed"), F.lit(FILTER_BITS)).cast("bigint")
    rows = strong.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits")).collect()  # FILTER_BITS / 8 bytes
    out = np.zeros(FILTER_BITS // 8 + 4096, dtype=np.uint8)
    for r in rows:
        # Bucket n holds the values (n - 1) * 32768 + 1 to n * 32768, and bucket 0 the value 0.
        bits = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
        out[r["b"] * len(bits) : (r["b"] + 1) * len(bits)] = bits
    return out


def corrections(vocab: DataFrame) -> DataFrame:
    """(word, printed): misread words and what was printed.

    Printed forms that no frequent word can be are dropped at once by a filter of bounded size; the join decides.
    """
    strong = vocab.where("n >= 3 and not word rlike '[ 0-9@+|$!]' or n >= 3 and word rlike '^[\\\\p{L}]+-[0-9]+k?$'").select(F.col("word").alias("printed"), F.col("n").alias("printed_n"))
    bits = known_word_bits(strong)

    def may_be(word: str) -> bool:
        h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)
        v = (h - (1 << 64) if h >> 63 else h) % FILTER_BITS
        bucket, position = (v + 32767) // 32768 if v > 0 else 0, (v - 1) % 32768 if v > 0 else 0
        return bool(bits[bucket * 4096 + position // 8] >> (position % 8) & 1)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(w, n, c) for w, n in zip(frame["word"], frame["n"]) for c in printed_forms(w) if may_be(c)]
            yield pd.DataFrame(rows, columns=["word", "n", "printed"])

    # Frequent words are never misreadings of still more frequent ones by chance: the ratio decides.
    told = vocab.where(F.length("word") >= SHORTEST_WORD)
    candidates = told.where(F.length("word") <= LONG_WORD).mapInPandas(run, "word string, n bigint, printed string")
    long_words = told.where(F.length("word") > LONG_WORD).withColumn("_f", folded(F.col("word")))
    long_strong = strong.where(F.length("printed") > LONG_WORD - 4).withColumn("_f", folded(F.col("printed")))
    by_fold = long_words.join(long_strong.select("_f", "printed"), "_f").where("word <> printed").select("word", "n", "printed")
    joined = candidates.unionByName(by_fold).join(strong, "printed").where((F.col("printed_n") >= FREQUENCY_RATIO * F.greatest(F.col("n"), F.lit(0))))
    fragment = vocab.select(F.col("word").alias("_f"), F.col("n").alias("_fn"))
    apart = joined.withColumn("_f", F.when(F.contains("word", F.lit(" ")), F.substring_index("word", " ", -1)))
    judged = apart.join(fragment, "_f", "left").where("_f is null or printed_n >= 8 * coalesce(_fn, 0)")
    return judged.groupBy("word").agg(F.max_by("printed", F.struct(F.col("printed_n"), F.col("printed"))).alias("printed"))


def joins(pairs: DataFrame, vocab: DataFrame, fixes: DataFrame) -> DataFrame:
    """(left, right, whole, keeps): how each broken word is joined; ``keeps`` says that the hyphen is its own."""
    plain, hyphened = F.concat("left", "right"), F.concat_ws("-", "left", "right")
    p = pairs.withColumn("_p", plain).withColumn("_h", hyphened)
    seen = vocab.select("word", "n")
    for c in ("_p", "_h"):
        p = p.join(seen.withColumnsRenamed({"word": c, "n": f"{c}n"}), c, "left").join(fixes.withColumnsRenamed({"word": c, "printed": f"{c}fix"}), c, "left")
        p = p.join(seen.withColumnsRenamed({"word": f"{c}fix", "n": f"{c}fixn"}), f"{c}fix", "left")
    weight = lambda c: F.coalesce(f"{c}n", F.lit(0)) + F.coalesce(f"{c}fixn", F.lit(0)) * 0.5
    number = F.col("right").rlike(r"^\d")
    keeps = F.when(weight("_h") != weight("_p"), weight("_h") > weight("_p")).otherwise(number)
    whole = F.when(keeps, F.coalesce("_hfix", "_h")).otherwise(F.coalesce("_pfix", "_p"))
    misread = F.when(keeps, F.col("_hfix").isNotNull()).otherwise(F.col("_pfix").isNotNull())
    return p.select("left", "right", whole.alias("whole"), keeps.alias("keeps"), misread.alias("misread"))


class Repair:
    """The stages of a repair, stored by ``cut`` where several results read them."""

    def __init__(self, papers: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage):
        self.edged = cut(find_edges(split_lines(papers), cut))
        self.body = cut(body_lines(self.edged))
        self.pairs = self.body.where("broken").select("left", "right").distinct()
        self.words = _words_of(self.body)
        self.vocab = cut(vocabulary(self.words, self.pairs))
        self.fixes = cut(corrections(self.vocab))
        self.joins = cut(joins(self.pairs, self.vocab, self.fixes))

    def found(self) -> DataFrame:
        """(parsed_id, part_name, noise, item): what was repaired."""
        removed = self.edged.where("noise is not null").select("parsed_id", "part_name", "noise", F.col("line").alias("item"))
        broken = self.body.where("broken").join(self.joins, ["left", "right"])
        hyphened = broken.select("parsed_id", "part_name", F.lit("hyphenation").alias("noise"), F.col("whole").alias("item"))
        both = broken.where("misread").select("parsed_id", "part_name", F.lit("misread").alias("noise"), F.col("whole").alias("item"))
        misread = self.words.distinct().join(self.fixes, "word").select("parsed_id", "part_name", F.lit("misread").alias("noise"), F.col("printed").alias("item"))
        return removed.unionByName(hyphened).unionByName(misread).unionByName(both).distinct()

    def text(self) -> DataFrame:
        """(parsed_id, part_name, entry, text): the repaired text, paragraphs apart by an empty line."""
        body = self.body.join(self.joins.select("left", "right", "keeps"), ["left", "right"], "left")
        line = F.when(F.col("broken"), F.concat(F.regexp_replace("line", rf"{HYPHEN}$", ""), F.when(F.col("keeps"), "-").otherwise(""))).otherwise(F.concat("line", F.lit(" ")))
        body = body.withColumn("_t", F.concat(F.when(F.col("paragraph") & (F.col("ln") > 0), "\n\n").otherwise(""), line))
        whole = body.groupBy("parsed_id", "part_name", "entry").agg(F.array_sort(F.collect_list(F.struct("ln", "_t"))).alias("_l"))
        whole = whole.select("parsed_id", "part_name", "entry", F.array_join(F.transform("_l", lambda x: x["_t"]), "").alias("_t"))
        tokens = whole.select("parsed_id", "part_name", "entry", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(\s*\S+)"), 1)).alias("_i", "token")).withColumn("word", _core(F.col("token")))
        fixed = tokens.join(self.fixes, "word", "left")
        shown = F.when(F.trim("token").rlike(r"^\P{L}*\p{Lu}"), F.concat(F.upper(F.substring("printed", 1, 1)), F.substr(F.col("printed"), F.lit(2)))).otherwise(F.col("printed"))
        head, tail = F.regexp_extract("token", r"^(\s*[^\p{L}\p{N}@+|$]*)", 1), F.regexp_extract("token", r"([^\p{L}\p{N}@+|$]*)$", 1)
        fixed = fixed.withColumn("token", F.when(F.col("printed").isNotNull(), F.concat(head, shown, tail)).otherwise(F.col("token")))
        out = fixed.groupBy("parsed_id", "part_name", "entry").agg(F.array_sort(F.collect_list(F.struct("_i", "token"))).alias("_l"))
        return out.select("parsed_id", "part_name", "entry", F.trim(F.array_join(F.transform("_l", lambda x: x["token"]), "")).alias("text"))
