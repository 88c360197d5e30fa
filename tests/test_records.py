import hashlib

from pyspark.sql import functions as F

from corpuslane.functions import scalars as S
from corpuslane.functions import text as X
from corpuslane.operators import records as R


def one(spark, expr, **cols):
    names = list(cols)
    schema = ", ".join(f"{n} {t}" for n, (t, _) in cols.items())
    return spark.createDataFrame([tuple(v for _, v in cols.values())], schema).select(expr.alias("x")).first()["x"] if names else None


def test_text_rules(spark):
    t = lambda expr, v: one(spark, expr, c=("string", v))
    c = F.col("c")
    assert t(X.clean_text(c), None) == "" and t(X.clean_text(c), " a \n b ") == "a b"
    assert t(X.truncate(c, 6), "abcdefgh") == "abc..." and t(X.truncate(c, 6), "abc") == "abc"
    assert t(X.bigrams(X.content_tokens(c)), "The quick brown fox") == ["quick brown", "brown fox"] and t(X.bigrams(X.content_tokens(c)), "fox") == []
    assert t(X.sentences(c), "One. Two! Three?") == ["One.", "Two!", "Three?"]
    assert t(X.sentence_role(c), "We propose a result.") == "method"
    assert t(X.output_source_ids(c), "see [S1, S9] and 2101.00001") == ["2101.00001", "S1", "S9"]
    assert t(X.between(c, "<a>", "</a>"), "x <a> y </a> z") == "y" and t(X.between(c, "<a>", "</a>"), "x") is None
    assert t(X.heading_key(c), "2.1  Related Work: ") == "related work"
    assert t(X.redact(c, ["secret"]), "a secret b") == "a [redacted-upload] b"
    assert one(spark, X.apa_authors(F.col("a")), a=("array<string>", ["Jane Doe", "John Q. Smith"])) == "Doe, J., & Smith, J. Q."
    assert one(spark, X.apa_authors(F.col("a")), a=("array<string>", [])) == "Unknown"


def test_scalar_rules(spark):
    y = F.col("y")
    assert [one(spark, S.era(y), y=("int", v)) for v in (2017, 2018, 2020, 2021, 2022, 2023, None)] == ["foundational", "established", "established", "recent", "recent", "current", None]
    assert [one(spark, S.recency(y), y=("int", v)) for v in (2024, 2014, 2010, None)] == [1.0, 0.0, 0.0, 0.5]
    d = lambda v: str(one(spark, S.published_date(F.col("d")), d=("string", v)))
    assert d("Mon, 2 Apr 2007 19:18:42 GMT") == "2007-04-02" and d("2020-05-06T00:00") == "2020-05-06" and d("bad") == "None"
    assert [one(spark, S.coverage_band(F.col("s")), s=("double", v)) for v in (0.6, 0.4, 0.2)] == ["eligible", "nearby", "rejected"]


def test_latest_and_problems(spark):
    rows = [("p1", "old", "2020-01-01 00:00:00", 1), ("p1", "new", "2021-01-01 00:00:00", 5), ("p1", "new", "2021-01-01 00:00:00", 5), (None, "x", "2020-01-01 00:00:00", 1), ("p2", "", None, None)]
    df = spark.createDataFrame(rows, "paper_id string, title string, loaded_at string, citation_count int").withColumn("influential_citation_count", F.lit(0))
    assert {(r.paper_id, r.title) for r in R.latest(df).collect()} == {("p1", "new"), ("p2", "")}
    full = df.selectExpr("paper_id", "title", "'' as abstract", "array('a') as authors", "array() as categories", "null as published_date", "'arxiv' as source", "citation_count")
    got = {r.problem for r in R.problems(full.where("paper_id = 'p2'").selectExpr("*").withColumn("published_date", F.col("published_date").cast("string"))).collect()}
    assert got == {"missing title", "missing abstract", "missing published_date", "empty categories"}


def test_quotas_and_samples(spark):
    strata = spark.createDataFrame([(c,) for c in "abcd"], "category string")
    q = {(r.category, r.bucket): r.quota for r in R.quotas(strata, 5000, {"foundational": 15, "established": 20, "recent": 25, "current": 40}).collect()}
    assert [q[("a", b)] for b in ("foundational", "established", "recent", "current")] == [187, 250, 313, 500]
    rows = spark.createDataFrame([(f"k{i}", "s" if i % 3 else "t") for i in range(60)], "k string, s string")
    a = {r.k for r in R.stratified_sample(rows, ["s"], F.lit(5), "k", "1").collect()}
    b = {r.k for r in R.stratified_sample(rows.repartition(7).orderBy(F.rand()), ["s"], F.lit(5), "k", "1").collect()}
    assert a == b and len(a) == 10
    want = sorted((f"k{i}" for i in range(60) if i % 3 == 0), key=lambda k: hashlib.sha256(f"1:{k}".encode()).hexdigest())[:5]
    assert set(want) <= a
    split = R.stratified_split(rows, "k", "s", "2", 80).groupBy("s", "split").count().collect()
    assert {(r.s, r.split): r["count"] for r in split} == {("s", "train"): 32, ("s", "test"): 8, ("t", "train"): 16, ("t", "test"): 4}


def test_nearest_percentile(spark):
    df = spark.createDataFrame([(v, "g") for v in (5, 1, 4, 2, 3, None)], "v int, g string")
    r = R.nearest_percentile(df, "v", [0.25, 0.75], ["g"]).first()
    assert (r.p25, r.p75) == (2, 4)
    assert R.nearest_percentile(df.where("false"), "v", [0.5], ["g"]).count() == 0


def test_python_functions(spark):
    from corpuslane.functions import python as Y

    assert Y.balanced_object('x {"a": "}", "b": {"c": 1}} y }') == '{"a": "}", "b": {"c": 1}}' and Y.balanced_object("{ {} ") == "{}" and Y.balanced_object("none") is None and Y.balanced_object(None) is None
    df = spark.createDataFrame([("abcd", "abcd"), ("abcd", "bcde"), (None, "a")], "a string, b string")
    assert [r.x for r in df.select(Y.sequence_ratio("a", "b").alias("x")).collect()] == [1.0, 0.75, None]
    assert [r.x for r in df.select(Y.first_json_object("a").alias("x")).collect()] == [None, None, None]


def test_hash_ranks_cut_a_hot_stratum_into_slices(spark):
    rows = [(k, None if k % 50 == 0 else "hot" if k % 10 else "cold") for k in range(2000)]
    df = spark.createDataFrame(rows, "k bigint, s string")
    want = {}
    for s in {s for _, s in rows}:
        order = sorted((k for k, x in rows if x == s), key=lambda k: hashlib.sha256(f"1:{k}".encode()).hexdigest())
        want |= {k: (i, len(order)) for i, k in enumerate(order, 1)}
    for digits in (1, 3):
        assert {r.k: (r._rn, r._size) for r in R.hash_ranks(df, ["s"], "k", "1", digits).collect()} == want
    for made in (R.stratified_sample(df, ["s"], F.lit(5), "k", "1"), R.stratified_split(df, "k", "s", "1", 80)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        windows = [x for x in plan.splitlines() if "row_number()" in x and "windowspecdefinition" in x]
        assert windows and all("_slice" in x for x in windows)
