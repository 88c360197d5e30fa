import random

from corpuslane.llm import sampling as S

PAPERS = "paper_id string, categories array<string>, rank int, leaf string"
TARGETS = "plan_id int, category string, share_bp int, min_rows int, sample_permille int, available int"


def papers(spark, n=500, seed=3):
    r = random.Random(seed)
    cats = ["cs.LG", " cs.lg", "CS.CL", "stat.ML", "cs.GL", "q-bio.QM"]
    rows = [(f"p{i}", [r.choices(cats, [40, 20, 15, 15, 1, 4])[0], "cs.AI"], 1, "x") for i in range(n)]
    rows += [("n1", None, 1, "x"), ("n2", [], 1, "x"), ("n3", ["  "], 1, "x"), (None, ["cs.LG"], 1, "x")]
    return rows + rows[:40]


PLANS = [(1, "cs.LG", 5000, 2, 300, 9), (1, "cs.GL", 3000, 2, 300, 9), (1, "stat.ML", 2000, 2, 300, 9), (2, "cs.XX", 5000, 7, 100, 9), (2, "cs.CL", 5000, 1, 100, 9), (3, "cs.GL", None, None, None, 9)]


def test_against_brute_force(spark):
    rows = papers(spark)
    p, t = spark.createDataFrame(rows, PAPERS), spark.createDataFrame(PLANS + PLANS[:1], TARGETS)
    primary = {(i, c[0].strip().lower()) for i, c, *_ in rows if i and c and c[0].strip()}
    n, size = len({i for i, _ in primary}), {}
    for _, c in primary:
        size[c] = size.get(c, 0) + 1
    want = {}
    for plan, cat, share, least, permille, _ in PLANS:
        target = max(least or 0, n * (permille or 0) // 1000 * (share or 0) // 10000)
        want[(plan, cat)] = (target, size.get(cat.lower(), 0))
    got = {(r.plan_id, r.category): r for r in S.allocate(t, S.category_counts(S.primary_categories(p))).collect()}
    assert {k: (r.target, r.available) for k, r in got.items()} == want
    assert {(r.plan_id, r.category) for r in S.unmet_targets(p, t).collect()} == {k for k, (a, b) in want.items() if b < a}
    for plan in (1, 2, 3):
        mine = [r for r in got.values() if r.plan_id == plan]
        assert all(0 <= r.quota <= r.available and r.quota >= min(r.target, r.available) for r in mine)
        assert sum(r.quota for r in mine) + mine[0].unfilled == sum(r.target for r in mine)
    assert got[(1, "cs.LG")].from_siblings >= 0 and got[(1, "stat.ML")].from_siblings == 0
    drawn = S.proportional_sample(p, t).collect()
    per = {}
    for r in drawn:
        per.setdefault((r.plan_id, r.category), set()).add(r.paper_id)
        assert (r.paper_id, r.category.lower()) in primary
    assert {k: len(v) for k, v in per.items()} == {k: r.quota for k, r in got.items() if r.quota}
    again = {(r.plan_id, r.category, r.paper_id) for r in S.proportional_sample(p.repartition(5), t).collect()}
    assert again == {(r.plan_id, r.category, r.paper_id) for r in drawn}


def test_rank_in_ranges_is_dense(spark):
    prim = S.primary_categories(spark.createDataFrame(papers(spark), PAPERS))
    counts = S.category_counts(prim)
    small = {(r.leaf, r["rank"]) for r in S.permuted_rank(prim, counts, "s", rows_per_bucket=7).collect()}
    assert small == {(r.leaf, i) for r in counts.collect() for i in range(r.available)}


def test_empty(spark):
    p, t = spark.createDataFrame([], PAPERS), spark.createDataFrame(PLANS, TARGETS)
    assert S.proportional_sample(p, t).count() == 0
    assert S.unmet_targets(p, t).count() == 5  # those with a minimum
    assert S.unmet_targets(spark.createDataFrame(papers(spark), PAPERS), t.where("false")).count() == 0
