"""Problem 3: link the spellings of names that stand for the same person or organisation.

Names are read into a family part, a given part and middle initials, whatever their order. Spellings of parts that
are one edit apart under the Damerau-Levenshtein distance (a true metric) meet by equal keys: what is left of a string
when one letter or none is left out. No key has more than a string a letter and place, so the work grows with the
strings and not with their pairs. By the triangle inequality no neighbour's distance to a pivot can differ by more than
the radius; distances to pivots far apart sort out pairs before the exact check. Near parts bring
near names together by equal keys, never by comparing all names of a group. Names that fit one entity are linked:
equal middles first, then names that leave parts out, then initials; a name that fits several entities equally well
is linked to none.

Defined results for odd input: null and blank names are left out; a name without letters stands alone; repeated rows
count once; one-word names are linked only to equal keys.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuslane.runtime import cut_lineage

RADIUS = 1
#: Pivots are spread over a sample of so many strings at most, chosen by hash.
PIVOTS, PIVOT_SAMPLE = 12, 2_000
#: A cell is a length and the distances to this many pivots; it shows how evenly the pivots part the strings.
RINGS = 3
#: A part seen in so many different names is a spelling of its own, not a slip of the pen.
ESTABLISHED = 4
#: ... unless the other spelling is so many times as common.
SLIP_RATIO = 12
SHORTEST_SLIP = 3

PARTICLES = frozenset("van von der den de del della di da dos du la le ter ten bin al el zu zum".split())
SUFFIXES = frozenset("jr sr ii iii iv".split())
# Short forms of given names and the names they may stand for.
NICKNAMES = {
    "alex": "alexander alexandra", "sasha": "alexander alexandra", "sandy": "alexander alexandra", "bea": "beatriz beatrice", "triz": "beatriz", "betty": "elizabeth", "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "eliza": "elizabeth", "libby": "elizabeth",
    "bill": "william", "will": "william", "billy": "william", "liam": "william", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert", "chris": "christopher christine christian", "kit": "christopher", "topher": "christopher",
    "chuck": "charles", "charlie": "charles", "carl": "charles", "dan": "daniel", "danny": "daniel", "deb": "deborah", "debbie": "deborah", "debra": "deborah", "ed": "edward edwin", "eddie": "edward edwin", "ned": "edward", "ted": "edward theodore", "teddy": "edward theodore", "theo": "theodore",
    "paco": "francisco", "pancho": "francisco", "frank": "francisco francis", "greg": "gregory", "beppe": "giuseppe", "pino": "giuseppe", "hank": "henry", "harry": "henry", "hannes": "johannes", "hans": "johannes", "jan": "johannes", "nacho": "ignacio", "jim": "james", "jimmy": "james", "jamie": "james",
    "jen": "jennifer", "jenny": "jennifer", "joe": "joseph", "joey": "joseph", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "maggie": "margaret", "meg": "margaret", "peggy": "margaret", "greta": "margaret", "mike": "michael", "mick": "michael", "mickey": "michael",
    "nick": "nicholas", "nico": "nicholas", "klaus": "nicholas", "pat": "patricia patrick", "patty": "patricia", "tricia": "patricia", "trish": "patricia", "becky": "rebecca", "becca": "rebecca", "rick": "richard", "dick": "richard", "rich": "richard", "ricky": "richard", "sam": "samuel samantha", "sammy": "samuel",
    "sue": "susan", "susie": "susan", "suzy": "susan", "tom": "thomas", "tommy": "thomas", "vicky": "victoria", "vic": "victoria victor", "tori": "victoria", "zosia": "zofia", "kasia": "katarzyna", "misha": "mikhail", "pepe": "jose", "leo": "leopold", "gwen": "gwendolyn", "uli": "ulrike", "dave": "david", "tony": "anthony", "steve": "steven stephen", "matt": "matthew", "andy": "andrew", "ben": "benjamin", "tim": "timothy",
}
# Kinds of organisations, with the shortened words for them.
KINDS = {
    "university": "university", "univ": "university", "institute": "institute", "inst": "institute", "technology": "technology", "technol": "technology", "tech": "technology", "laboratory": "laboratory", "lab": "laboratory", "laboratories": "laboratory", "labs": "laboratory",
    "collaboration": "collaboration", "collab": "collaboration", "consortium": "consortium", "centre": "centre", "center": "centre", "ctr": "centre", "department": "department", "dept": "department", "college": "college", "school": "school", "academy": "academy", "foundation": "foundation", "group": "group", "team": "team", "society": "society",
}
LONG_KINDS = ("university", "institute", "technology", "laboratory", "collaboration", "consortium")
FILLERS = frozenset("the of for and a".split())
LETTERS = str.maketrans({"ł": "l", "ø": "o", "đ": "d", "ð": "d", "þ": "th", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents; umlauts written out (ae, oe, ue) fall together with plain vowels."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c)).translate(LETTERS)
    return re.sub(r"([aou])e", r"\1", plain)


FOLDED_KINDS = {fold(k): v for k, v in KINDS.items()}


def one_edit(a: str, b: str) -> bool:
    """Whether two strings are at most one insertion, deletion, change or swap of neighbours apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def _kind(word: str) -> str | None:
    """The kind of organisation that a word names; a long word may be one slip away from it."""
    if word in FOLDED_KINDS:
        return FOLDED_KINDS[word]
    return next((k for k in LONG_KINDS if one_edit(k, word)), None) if len(word) >= 8 else None


def distances(pivot: str, strings: list[str]) -> np.ndarray:
    """Damerau-Levenshtein distances (unrestricted, so a metric) of one string to many, in vector steps."""
    n, most = len(strings), max((len(s) for s in strings), default=0)
    codes = np.zeros((n, most + 1), dtype=np.int32)
    alphabet = {c: i + 1 for i, c in enumerate(sorted(set(pivot) | {c for s in strings for c in s}))}
    for r, s in enumerate(strings):
        codes[r, : len(s)] = [alphabet[c] for c in s]
    m, rows = len(pivot), np.arange(n)
    far = most + m
    h = np.full((n, most + 2, m + 2), far, dtype=np.int32)
    h[:, 1:, 1] = np.arange(most + 1)
    h[:, 1, 1:] = np.arange(m + 1)
    last_row = np.zeros((n, len(alphabet) + 1), dtype=np.int32)
    for i in range(1, most + 1):
        last_col = np.zeros(n, dtype=np.int32)
        for j in range(1, m + 1):
            c = alphabet[pivot[j - 1]]
            row, col = last_row[:, c], last_col
            same = codes[:, i - 1] == c
            swap = h[rows, row, col] + (i - row - 1) + 1 + (j - col - 1)
            h[:, i + 1, j + 1] = np.minimum(np.minimum(h[:, i, j] + ~same, h[:, i + 1, j] + 1), np.minimum(h[:, i, j + 1] + 1, swap))
            last_col = np.where(same, j, last_col)
        last_row[rows, codes[:, i - 1]] = i
    return h[rows, np.fromiter((len(s) + 1 for s in strings), dtype=np.int64, count=n), m + 1] if n else np.zeros(0, dtype=np.int32)


def read_name(name: str) -> tuple[str, str, str, list[str], list[str]]:
    """(kind, family, given, middles, undecided): the parts of a name.

    ``undecided`` holds the two words of a name whose order only the corpus can tell; family and given then follow
    the usual order.
    """
    plain = fold(name)
    words = re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", plain)
    kinds = [k for w in words if (k := _kind(w))]
    if kinds and "," not in name or kinds and len(words) > 1 and len(kinds) >= 1:
        rest = [w for w in words if not _kind(w) and w not in FILLERS]
        if "technology" in kinds:
            kinds = ["technology"]
        if "collaboration" in kinds:
            kinds = ["collaboration"]
        return "org", "".join(rest), "".join(sorted(set(kinds))), [], []
    squash = lambda w: re.sub(r"['’\-]", "", w)
    before, comma, after = plain.partition(",")
    raw_before = name.partition(",")[0]
    if comma and re.search(r"[^\W\d_]", after) and not all(w in SUFFIXES for w in re.findall(r"[^\W\d_]+", after)):
        family = "".join(squash(w) for w in re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", before) if w not in SUFFIXES)
        given = [squash(w) for w in re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", after) if w not in SUFFIXES]
        return "person", family, given[0] if given else "", [w[0] for w in given[1:]], []
    shown = [w for w in re.findall(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", raw_before) if fold(w) not in SUFFIXES]
    if not shown:
        return "person", "".join(map(squash, words)), "", [], []
    low = [fold(w) for w in shown]
    some_small = any(w[0].islower() for w in shown) and not all(w[0].islower() for w in shown)
    particle = [w in PARTICLES or (some_small and s.islower() and len(w) > 1) for w, s in zip(low, shown)]
    is_initial = [len(w) == 1 for w in low]
    full = [i for i in range(len(low)) if not is_initial[i] and not particle[i]]
    words = [squash(w) for w in low]
    if len(low) == 1 or not full:
        return "person", "".join(words), "", [], []
    capital = [i for i in full if shown[i].isupper() and len(shown[i]) > 1]
    first_family = next((i for i in range(len(low)) if not particle[i]), 0)
    start_particle = particle[0]
    if len(full) > 1 and 0 < len(capital) < len(full):
        family_at = capital
    elif is_initial[-1] or (start_particle and len(full) > 1):
        family_at = [first_family]
    else:
        family_at = [full[-1]]
    at = family_at[0]
    begin = at
    while begin > 0 and particle[begin - 1]:
        begin -= 1
    family = "".join(words[begin : family_at[-1] + 1])
    given = [w for i, w in enumerate(words) if not (begin <= i <= family_at[-1]) and not (particle[i] and len(w) > 1)]
    undecided = [words[0], words[1]] if len(low) == 2 and len(full) == 2 and not (0 < len(capital) < len(full)) else []
    return "person", family, given[0] if given else "", [w[0] for w in given[1:]], undecided


READ_SCHEMA = "name string, kind string, family string, given string, middle string, one string, two string"


def read_names(names: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """One row for each name with its parts, each read once; two-word names take the order that the corpus uses for their words."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["name"]:
                kind, family, given, middles, undecided = read_name(name)
                rows.append((name, kind, family, given, "".join(middles), *(undecided or (None, None))))
            yield pd.DataFrame(rows, columns=["name", "kind", "family", "given", "middle", "one", "two"])

    read = cut(names.mapInPandas(run, READ_SCHEMA))
    roles = read.where("kind = 'person'").select(F.explode(F.array(F.struct(F.col("family").alias("w"), F.lit(1).alias("f")), F.struct(F.col("given").alias("w"), F.lit(0).alias("f")))).alias("r"))
    uses = cut(roles.groupBy("r.w").agg(F.sum("r.f").alias("f"), F.count("*").alias("n")))
    open_, settled = read.where("one is not null"), read.where("one is null")
    for c in ("one", "two"):
        open_ = open_.join(uses.withColumnsRenamed({"w": c, "f": f"{c}_f", "n": f"{c}_n"}), c)
    # The usual order is given, family; it is turned round where the words' other uses (without this one) say so.
    turned = (F.col("one_f") + 0.5) / F.col("one_n") - (F.col("two_f") - 0.5) / F.col("two_n") > 0.2
    decided = open_.withColumn("family", F.when(turned, F.col("one")).otherwise(F.col("two"))).withColumn("given", F.when(turned, F.col("two")).otherwise(F.col("one")))
    columns = ["name", "kind", "family", "given", "middle"]
    return settled.select(*columns).unionByName(decided.select(*columns))


def spread_pivots(sample: list[str], most: int = PIVOTS) -> list[str]:
    """Strings of ``sample`` far from each other: each next one is the farthest from those chosen so far.

    Strings over twice the middle length are no pivots: they are far from all others alike.
    """
    if not sample:
        return []
    middle = sorted(map(len, sample))[len(sample) // 2]
    sample = [s for s in sample if len(s) <= 2 * middle]
    chosen, nearest = [sample[0]], None
    while len(chosen) < min(most, len(sample)):
        d = distances(chosen[-1], sample)
        nearest = d if nearest is None else np.minimum(nearest, d)
        if nearest.max() == 0:
            break
        chosen.append(sample[int(nearest.argmax())])
    return chosen


def near_strings(strings: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage, report: dict | None = None) -> DataFrame:
    """(a, b), both orders: pairs of different strings of ``strings`` (column s) within RADIUS of each other.

    Strings one edit apart are equal once a letter or none is left out of each, so they meet by equal keys; a key has at
    most one string a letter and place, whatever their number. Few pivots far apart go along with the tasks: by the
    triangle inequality, pairs whose distances to a pivot differ by more than the radius are dropped before the edit
    distance. ``report`` gets the number of strings and pivots.
    """
    strings = cut(strings.where(F.length("s") >= SHORTEST_SLIP).distinct())
    sample = [r["s"] for r in strings.orderBy(F.xxhash64("s"), "s").limit(PIVOT_SAMPLE).collect()]  # bounded by PIVOT_SAMPLE
    chosen = spread_pivots(sample)
    if report is not None:
        report.update(strings=strings.count(), pivots=len(chosen))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            # Strings of like length go together, as the longest sets the steps.
            frame = frame.sort_values("s", key=lambda s: s.str.len(), ignore_index=True)
            for begin in range(0, len(frame), 1000):
                part = [str(s) for s in frame["s"][begin : begin + 1000]]
                if part and chosen:
                    yield pd.DataFrame({"s": part, "d": list(np.stack([distances(p, part) for p in chosen], axis=1).astype(np.int32))})

    placed = strings.mapInPandas(place, "s string, d array<int>")
    # The last key leaves nothing out.
    short = F.transform(F.sequence(F.lit(0), F.length("s")), lambda i: F.xxhash64(F.concat(F.substr("s", F.lit(1), i), F.substr("s", i + 2))))
    keyed = placed.select(F.explode(F.array_distinct(short)).alias("_v"), F.struct("s", "d").alias("_x"))
    groups = keyed.groupBy("_v").agg(F.collect_list("_x").alias("_l")).where(F.size("_l") > 1)
    met = groups.select("_l", F.explode("_l").alias("_a")).select(F.col("_a.s").alias("a"), F.col("_a.d").alias("_da"), F.explode("_l").alias("_b")).select("a", "_da", F.col("_b.s").alias("b"), F.col("_b.d").alias("_db"))
    # Equal pairs meet once in a key: the smaller string is the home. The pivots sort out pairs before the edit distance.
    apart = F.exists(F.zip_with("_da", "_db", lambda x, y: F.abs(x - y) > RADIUS), lambda x: x)
    joined = met.where((F.col("a") < F.col("b")) & ~apart).where(F.levenshtein("a", "b", 2) >= 0).select("a", "b").distinct()
    # Two neighbouring letters changed places: one edit of the metric, two of the plain edit distance.
    chars = F.zip_with(F.split("a", ""), F.split("b", ""), lambda x, y: x != y)
    at = F.array_position(F.transform(chars, lambda x: x.cast("int")), 1).cast("int")
    swapped = (F.length("a") == F.length("b")) & (F.concat(F.substr(F.col("a"), F.lit(1), at - 1), F.substr(F.col("a"), at + 1, F.lit(1)), F.substr(F.col("a"), at, F.lit(1)), F.substr(F.col("a"), at + 2)) == F.col("b"))
    found = joined.where((F.levenshtein("a", "b", 1) >= 0) | swapped)
    return found.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_p")).select("_p.a", "_p.b")


def slips(units: DataFrame, part: str, apart: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): spellings of a part one edit apart that are not both spellings of their own."""
    seen = units.groupBy(F.col(part).alias("s")).agg(F.count_distinct(apart).alias("uses")).where(F.length("s") > 1)
    seen = cut(seen)
    pairs = near_strings(seen.select("s"), cut)
    for c in ("a", "b"):
        pairs = pairs.join(seen.withColumnsRenamed({"s": c, "uses": f"{c}_uses"}), c)
    rarer, other = F.least("a_uses", "b_uses"), F.greatest("a_uses", "b_uses")
    return cut(pairs.where((rarer < ESTABLISHED) | (rarer * SLIP_RATIO <= other)).select("a", "b"))


def connected(nodes: DataFrame, edges: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, root): the smallest id that each node reaches over ``edges`` (a, b, both orders); runs until nothing moves."""
    state = cut(nodes.select("id", F.col("id").alias("root")))
    while True:
        offered = edges.join(state.withColumnsRenamed({"id": "a", "root": "r"}), "a").groupBy(F.col("b").alias("id")).agg(F.min("r").alias("r"))
        after = state.join(offered, "id", "left").select("id", F.least("root", F.coalesce("r", "root")).alias("root"), (F.col("r") < F.col("root")).alias("moved"))
        # A node also takes the root of its root, which halves the way.
        jump = after.select(F.col("id").alias("root"), F.col("root").alias("far"))
        after = cut(after.join(jump, "root", "left").select("id", F.least("root", F.coalesce("far", "root")).alias("root"), "moved"))
        state = after.select("id", "root")
        if after.where("moved").limit(1).count() == 0:
            return state


def link_names(papers: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut_lineage) -> DataFrame:
    """(name, entity): every distinct spelling with the entity it stands for."""
    spark: SparkSession = papers.sparkSession
    names = papers.select(F.explode("authors").alias("name")).where(F.col("name").rlike(r"\p{L}")).distinct()
    read = cut(read_names(names, cut))
    units = cut(read.select("kind", "family", "given", "middle").distinct().withColumn("id", F.concat_ws("|", "kind", "family", "given", "middle")))
    family_slips = slips(units.where("family <> ''"), "family", "given", cut)
    given_slips = slips(units.where("given <> ''"), "given", "family", cut)
    short = spark.createDataFrame([(fold(n), fold(f)) for n, fs in NICKNAMES.items() for f in fs.split()], "a string, b string")

    def other(pairs: DataFrame, cost: int) -> DataFrame:
        return pairs.select("a", "b", F.lit(cost).alias("cost"))

    whole = units.where(F.length("given") > 1)
    same = lambda c: units.select(F.col(c).alias("a"), F.col(c).alias("b")).distinct()
    families = cut(other(same("family"), 0).unionByName(other(family_slips, 2)))
    nick = short.unionByName(short.select(F.col("b").alias("a"), F.col("a").alias("b")))
    givens = cut(other(same("given"), 0).unionByName(other(given_slips, 2)).unionByName(other(nick, 1)).groupBy("a", "b").agg(F.min("cost").alias("cost")))

    # Units with whole given names meet over near family and near given parts, as equal keys.
    keyed = whole.join(families.withColumnsRenamed({"a": "family", "b": "f2", "cost": "fc"}), "family").join(givens.withColumnsRenamed({"a": "given", "b": "g2", "cost": "gc"}), "given")
    target = whole.select(F.col("family").alias("f2"), F.col("given").alias("g2"), F.col("kind").alias("k2"), F.col("middle").alias("m2"), F.col("id").alias("id2"))
    met = keyed.join(target, ["f2", "g2"]).where((F.col("kind") == F.col("k2")) & (F.col("id") != F.col("id2"))).withColumn("cost", F.col("fc") + F.col("gc"))
    met = cut(met.select("id", "id2", "middle", "m2", "cost"))
    strong = met.where("middle = m2").select(F.col("id").alias("a"), F.col("id2").alias("b"))
    root = connected(whole, cut(strong.unionByName(strong.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()), cut)

    # A unit that leaves the middle out joins the one entity that it fits best.
    with_root = met.where("middle = '' and m2 <> ''").join(root.withColumnsRenamed({"id": "id2", "root": "to"}), "id2").join(root.withColumnsRenamed({"root": "own"}), "id")
    offers = with_root.groupBy("own", "to").agg(F.min("cost").alias("cost"))
    moves = _only_best(offers, "own", ["cost"]).select(F.col("own").alias("root"), F.col("to"))
    entity = cut(root.join(moves, "root", "left").select("id", F.coalesce("to", "root").alias("entity")))

    # Initials join the one entity of the family that they fit best.
    brief = units.where((F.length("given") == 1) & (F.col("kind") == "person"))
    full = whole.where("kind = 'person'").join(entity, "id").select(F.col("family").alias("f2"), F.substring("given", 1, 1).alias("given"), F.col("middle").alias("m2"), F.col("entity").alias("to")).distinct()
    fits = brief.join(families.withColumnsRenamed({"a": "family", "b": "f2", "cost": "fc"}), "family").join(full, ["f2", "given"])
    fits = fits.where((F.col("middle") == F.col("m2")) | (F.col("middle") == "") | (F.col("m2") == ""))
    gap = F.when(F.col("middle") == F.col("m2"), 0).otherwise(1)
    offers = fits.groupBy("id", "to").agg(F.min(F.col("fc") * 2 + gap).alias("cost"))
    found = _only_best(offers, "id", ["cost"])
    lone = cut(brief.select("id").join(found, "id", "left").select("id", F.coalesce("to", "id").alias("entity")))
    rest = units.where((F.length("given") == 0) | ((F.length("given") == 1) & (F.col("kind") != "person"))).select("id", F.col("id").alias("entity"))
    every = entity.unionByName(lone).unionByName(rest)
    return read.withColumn("id", F.concat_ws("|", "kind", "family", "given", "middle")).join(every, "id").select("name", "entity")


def _only_best(offers: DataFrame, key: str, by: list[str]) -> DataFrame:
    """The best offer of each key, where no other is as good."""
    best = Window.partitionBy(key)
    ranked = offers.withColumn("_best", F.min("cost").over(best)).where("cost = _best").withColumn("_n", F.count("*").over(best))
    return ranked.where("_n = 1").drop("_best", "_n")


def name_pairs(linked: DataFrame) -> DataFrame:
    """(name_a, name_b): each pair of different spellings of one entity."""
    several = linked.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity")
    kept = linked.join(several, "entity", "left_semi")
    a, b = kept.select("entity", F.col("name").alias("name_a")), kept.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
