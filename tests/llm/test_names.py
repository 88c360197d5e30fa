from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslane.llm import names as N

SCHEMA = "paper_id string, authors array<string>, name string, entity string"
ADA = ["Zdeněk P. Kovbaldur", "Kovbaldur, Zdeněk P.", "KOVBALDUR Zdenek P.", "Z. P. Kovbaldur", "Kovbladur, Zdeněk P."]
BOB = ["Robert Tanfelmer", "Bob Tanfelmer", "R. Tanfelmer", "tanfelmer, robert", "Tanfelmer Robert"]
ORG = ["University of Gasvombit", "Univ. of Gasvombit", "University, Gasvombit", "The University of Gasvombit"]
APART = ["Anneke J. Livlobsum", "Anneke T. Livlobsum", "A. Livlobsum"]


def dl(a, b):
    """Unrestricted Damerau-Levenshtein, cell by cell."""
    last, far = {}, len(a) + len(b)
    h = {(-1, -1): far}
    for i in range(len(a) + 1):
        h[i, -1], h[i, 0] = far, i
    for j in range(len(b) + 1):
        h[-1, j], h[0, j] = far, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), db
            cost = a[i - 1] != b[j - 1]
            if not cost:
                db = j
            h[i, j] = min(h[i - 1, j - 1] + cost, h[i, j - 1] + 1, h[i - 1, j] + 1, h[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return h[len(a), len(b)]


word = st.text("abcd", max_size=7)


@settings(max_examples=150, deadline=None)
@given(word, st.lists(word, max_size=5))
def test_distances(p, many):
    assert list(N.distances(p, many)) == [dl(p, s) for s in many]
    assert all(N.one_edit(p, s) == (dl(p, s) <= 1) for s in many)


def pairs(spark, lists):
    df = spark.createDataFrame([(str(i), a, "x", "y") for i, a in enumerate(lists)], SCHEMA)
    return {(r.name_a, r.name_b) for r in N.name_pairs(N.link_names(df)).collect()}


def every(names):
    return {tuple(sorted((a, b))) for a in names for b in names if a != b}


def test_links(spark):
    filler = [f"{g} Kovbaldur" for g in ("Wanjiru", "Ursula", "Hamza", "Oskar", "Ragnar")] + [f"{g} Tanfelmer" for g in ("Xanthe", "Quentin", "Dalia", "Emeka")]
    got = pairs(spark, [[n] for n in ADA + BOB + ORG + APART + filler + filler] + [None, [], [None, "", "  ", "???"], ["Zdeněk P. Kovbaldur", "Zdeněk P. Kovbaldur"]])
    assert every(ADA) | every(BOB) | every(ORG) <= got
    assert not any({a, b} & set(APART) for a, b in got)  # two people share the initial
    assert got == every(ADA) | every(BOB) | every(ORG)


def test_near_strings_equals_brute_force(spark):
    import random

    r = random.Random(5)
    base = ["".join(r.choices("bdgklmnrst", k=r.randint(5, 9))) for _ in range(120)]
    strings = set(base)
    for s in base:
        i = r.randrange(len(s) - 1)
        strings |= {s[:i] + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + "a" + s[i:]}
    got = {(x.a, x.b) for x in N.near_strings(spark.createDataFrame([(s,) for s in strings], "s string")).collect()}
    kept = [s for s in strings if len(s) >= N.SHORTEST_SLIP]
    assert got == {(a, b) for a in kept for b in kept if a != b and dl(a, b) <= 1}


def test_empty_and_long(spark):
    assert pairs(spark, []) == set() and pairs(spark, [["Jane " + "x" * 5000]]) == set()


def test_long_short_and_chained_spellings(spark):
    long = "squashed" * 9  # 72 letters
    strings = [long, long[:40] + long[41:], "kim", "kin", "lee", "le"]
    got = {(x.a, x.b) for x in N.near_strings(spark.createDataFrame([(s,) for s in strings], "s string")).collect()}
    assert {(long, strings[1]), ("kim", "kin"), ("kin", "kim")} <= got and not any("le" in p for p in got)
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(150)]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a string, b string")
    nodes = spark.createDataFrame([(f"n{i:03d}",) for i in range(151)] + [("z",)], "id string")
    roots = {r.id: r.root for r in N.connected(nodes, both, N.cut_lineage).collect()}
    assert roots == {f"n{i:03d}": "n000" for i in range(151)} | {"z": "z"}


def test_few_pairs_reach_the_edit_distance():
    """Share of the pairs of like length that pass all pivots, over made-up surnames; greatest cell."""
    import random

    import numpy as np

    r = random.Random(11)
    strings = list({"".join(r.choice("bdfgklmnprstv") + r.choice("aeiou") + r.choice(["", "", "n", "r", "l"]) for _ in range(r.randint(2, 4))) for _ in range(4000)})
    chosen = N.spread_pivots(strings[: N.PIVOT_SAMPLE])
    d = np.stack([N.distances(p, strings) for p in chosen], axis=1)
    n = np.array([len(s) for s in strings])
    like = passed = 0
    for i in range(0, len(strings), 20):
        near = abs(n - n[i]) <= 1
        like += near.sum() - 1
        passed += (near & (abs(d - d[i]) <= 1).all(axis=1)).sum() - 1
    cells = np.unique(np.column_stack([n, d[:, : N.RINGS]]), axis=0, return_counts=True)[1]
    assert passed < 0.1 * like and cells.max() < 0.1 * len(strings)


def test_no_plan_is_big(spark):
    """A driver holds the plans: every stored stage and the result stay small."""
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return N.cut_lineage(df)

    lists = [[n] for n in ADA + BOB + ORG + APART]
    out = N.link_names(spark.createDataFrame([(str(i), a, "x", "y") for i, a in enumerate(lists)], SCHEMA), cut)
    plans.append(out._jdf.queryExecution().executedPlan().toString().count("Exchange"))
    assert max(plans) <= 12, plans


def test_keys_meet_few_strings(spark):
    """Strings that no pivot tells apart are not all compared: rows grow with the strings, not with their pairs."""
    import itertools

    strings = ["".join(p) + "".join(q) for p in itertools.permutations("abcde") for q in itertools.permutations("fghij")][::4]
    found = N.near_strings(spark.createDataFrame([(s,) for s in strings], "s string"))
    got = {(r.a, r.b) for r in found.collect()}
    known = set(strings)
    swaps = {(s, t) for s in strings for i in range(9) if (t := s[:i] + s[i + 1] + s[i] + s[i + 2 :]) in known and t != s}
    assert got == swaps
