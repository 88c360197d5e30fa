import math
from collections import Counter

from pyspark.sql import functions as F

from corpuslane.functions import text as X
from corpuslane.operators import evaluation as E
from corpuslane.operators import retrieval as T

DOCS = [(1, "graph neural model for text"), (2, "neural ranking of text text"), (3, "graph theory"), (4, None), (5, ""), (6, "neural ranking of text text")]
QUERIES = [(1, "neural text"), (2, "graph"), (3, ""), (4, None), (None, "graph")]


def make(spark):
    d = spark.createDataFrame(DOCS + DOCS[:1], "doc_id bigint, text string").withColumn("rank", F.lit(1)).withColumn("term", F.lit("x"))
    return T.build_index(d), spark.createDataFrame(QUERIES, "query_id bigint, text string")


def words(t):
    return [w for w in (t or "").split() if w not in X.STOP_WORDS]


def rows(df):
    return {(r.query_id, r.doc_id): (r.score, r["rank"]) for r in df.collect()}


def test_tfidf_by_hand(spark):
    i, q = make(spark)
    got = rows(T.tfidf(i, q, 10))
    n, tf = len(DOCS), {d: Counter(words(t)) for d, t in DOCS}
    df = Counter(w for c in tf.values() for w in c)
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1
    for qid, text in QUERIES[:2]:
        qv = {w: idf(w) for w in words(text) if w in df}
        qn = math.sqrt(sum(v * v for v in qv.values()))
        for d, c in tf.items():
            dn = math.sqrt(sum((x * idf(w)) ** 2 for w, x in c.items()))
            s = sum(qv[w] * c[w] * idf(w) for w in qv if w in c) / (qn * dn) if dn else 0
            assert ((qid, d) in got) == (s > 0)
            if s > 0:
                assert abs(got[(qid, d)][0] - s) < 1e-8
    assert got[(1, 2)][0] == got[(1, 6)][0] and got[(1, 2)][1] + 1 == got[(1, 6)][1]  # a tie goes to the smaller id


def test_bm25_okapi_floor(spark):
    i, q = make(spark)
    got = rows(T.bm25(i, q, 10))
    n, tf = len(DOCS), {d: Counter(words(t)) for d, t in DOCS}
    df, avg = Counter(w for c in tf.values() for w in c), sum(sum(c.values()) for c in tf.values()) / n
    raw = {w: math.log((n - x + 0.5) / (x + 0.5)) for w, x in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    c = tf[2]
    want = sum(idf[w] * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * sum(c.values()) / avg)) for w in ("neural", "text"))
    assert (want > 0) == ((1, 2) in got) and (want <= 0 or abs(got[(1, 2)][0] - want) < 1e-8)
    assert rows(T.bm25(T.build_index(spark.createDataFrame([], "doc_id bigint, text string")), q, 3)) == {}


def test_nearest_matches_brute_force(spark):
    e = spark.range(200).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(i * F.col("id")).cast("float")).alias("vec"))
    q = e.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("vec").alias("qvec"))
    got = {}
    for r in T.nearest(e.repartition(5), q, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    vs = {r.doc_id: r.vec for r in e.collect()}
    for qid in (0, 50, 100, 150):
        best = sorted(vs, key=lambda d: (-round(sum(a * b for a, b in zip(vs[qid], vs[d])), 9), d))[:5]
        assert [d for _, d in sorted(got[qid])] == best


def test_rrf_and_min_max(spark):
    lists = spark.createDataFrame([(1, 1, 9.0, 1, "bm25"), (1, 2, 8.0, 2, "bm25"), (1, 2, 3.0, 1, "dense"), (1, 1, 2.0, 2, "dense"), (1, 3, 1.0, 3, "dense")], "query_id bigint, doc_id bigint, score double, rank int, component string")
    r = {x.doc_id: x for x in T.reciprocal_rank_fusion(lists, {"bm25": 0.6, "dense": 0.4}, 5).collect()}
    assert abs(r[1].score - (0.6 / 61 + 0.4 / 62)) < 1e-9 and r[1]["rank"] == 1 and r[3].bm25_rank == 0 and abs(r[3].score - 0.4 / 63) < 1e-9
    same = lists.withColumn("score", F.lit(4.0))
    assert {x.normal for x in T.min_max(same).collect()} == {0.5}


def test_metrics(spark):
    gold = spark.createDataFrame([(1, d) for d in range(1, 6)] + [(2, 9), (1, 1)], "query_id bigint, doc_id bigint")
    res = spark.createDataFrame([(1, 1, 1), (1, 77, 2)], "query_id bigint, doc_id bigint, rank int")
    m = {r.query_id: r for r in E.ranking_metrics(res, gold, 5).collect()}
    assert m[1].recall == 0.2 and m[1].ndcg_retrieved == 1.0 and abs(m[1].ndcg_standard - 0.339160) < 1e-6
    assert m[2].precision == 0 and m[2].rr == 0
    gold2 = spark.createDataFrame([(1, 1), (1, 2)], "query_id bigint, doc_id bigint")
    res2 = spark.createDataFrame([(1, 1, 1), (1, 5, 2), (1, 2, 3)], "query_id bigint, doc_id bigint, rank int")
    m2 = E.ranking_metrics(res2, gold2, 5).first()
    assert abs(m2.ap - 0.833333) < 1e-6 and m2.precision == 0.4
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "actual string, predicted string")
    c = {r.label: r for r in E.class_metrics(pairs).collect()}
    assert c["b"].precision == round(1 / 3, 6) and c["b"].recall == 1 and c["c"].f1 == 0 and c["a"].support == 2


def test_whole_rankings_reach_beyond_any_depth(spark):
    """Ranks past 50 stay ranks, in ranges of any size; the 60th document keeps a share of its scaled score."""
    scores = [(q, d, float((d * 7) % 40), c) for q in (1, 2) for d in range(1, 121) for c in ("bm25", "tfidf")]
    s = spark.createDataFrame(scores, "query_id bigint, doc_id bigint, score double, component string")
    want = {(q, c, d): i for q in (1, 2) for c in ("bm25", "tfidf") for i, (_, d) in enumerate(sorted((-float((d * 7) % 40), d) for d in range(1, 121)), 1)}
    for size in (7, 100_000):
        assert {(r.query_id, r.component, r.doc_id): r["rank"] for r in T.full_ranks(s, ("query_id", "component"), size).collect()} == want
    scaled = T.min_max_columns(T.side_by_side(s, ("bm25", "tfidf")), ("bm25", "tfidf"))
    assert {(r.query_id, r.doc_id): round(r.bm25, 6) for r in scaled.collect()} == {(q, d): round((d * 7) % 40 / 39, 6) for q in (1, 2) for d in range(1, 121)}
    two = scaled.withColumn("tfidf", 1 - F.col("bm25"))
    lead = {r.doc_id for r in T.may_lead(two, 5, "bm25", "tfidf").where("query_id = 1").collect()}
    for w in range(21):
        best = sorted((-(w / 20 * ((d * 7) % 40) / 39 + (1 - w / 20) * (1 - (d * 7) % 40 / 39)), d) for d in range(1, 121))[:5]
        assert {d for v, d in best if v < best[-1][0] - 1e-9} <= lead


def test_stored_index_is_reused_only_for_the_same_corpus_and_analyzer(spark, tmp_path):
    d = spark.createDataFrame(DOCS + DOCS[:1], "doc_id bigint, text string").withColumn("term", F.lit("x"))
    q = spark.createDataFrame(QUERIES, "query_id bigint, text string")
    folder = str(tmp_path)
    first = T.stored_index(d, folder)
    again = T.stored_index(d.repartition(3), folder)
    meta = lambda: spark.read.parquet(f"{folder}/meta").count()
    assert meta() == 1 and first.postings.inputFiles() == again.postings.inputFiles()
    assert rows(T.bm25(again, q, 10)) == rows(T.bm25(T.build_index(d), q, 10)) and rows(T.tfidf(again, q, 10)) == rows(T.tfidf(T.build_index(d), q, 10))
    assert sorted(map(tuple, again.docs.select("doc_id", "dl").collect())) == [(i, len(words(t))) for i, t in DOCS]
    T.stored_index(d.where("doc_id <> 3"), folder)
    T.stored_index(d, folder, lambda c: F.split(c, " "))
    assert meta() == 3
    assert T.saved_index(spark, str(tmp_path / "none"), "a", "b") is None and T.saved_index(spark, folder, "a", "b") is None
    empty = T.stored_index(spark.createDataFrame([], "doc_id bigint, text string"), folder)
    assert rows(T.bm25(empty, q, 3)) == {} and rows(T.tfidf(empty, q, 3)) == {}


def test_lexical_scores_equal_the_single_searches(spark):
    i, q = make(spark)
    got = {(r.query_id, r.doc_id): (r.tfidf, r.bm25) for r in T.lexical_scores(i, q).collect()}
    for place, one in enumerate((T.tfidf(i, q, None), T.bm25(i, q, None))):
        want = {(r.query_id, r.doc_id): r.score for r in one.collect()}
        have = {k: v[place] for k, v in got.items() if v[place] is not None}
        assert have.keys() == want.keys() and all(abs(have[k] - want[k]) < 1e-8 for k in want)
    terms = T.documents_as_queries(i, F.col("doc_id") == 2)
    assert {(r.term, r.qtf) for r in terms.collect()} == set(Counter(words(dict(DOCS)[2])).items())


def test_one_text_moves_only_repeated_ids(spark, monkeypatch):
    from corpuslane.operators import records

    made = spark.createDataFrame([(1, "a"), (1, "b"), (2, None), (3, "c"), (3, None), (None, "d")], "doc_id bigint, text string")
    want = [(1, "b"), (2, None), (3, "c")]
    assert sorted(map(tuple, records.one_text(made).collect())) == want
    monkeypatch.setattr(records, "REPEATED_IDS_SENT", 1)
    assert sorted(map(tuple, records.one_text(made).collect())) == want
    single = records.one_text(made.where("doc_id = 2"))
    assert "Exchange" not in single._jdf.queryExecution().executedPlan().toString() and single.count() == 1


def test_section_texts_and_reasons(spark):
    from corpuslane.functions import rules as R

    cue = {role: cues[0] for role, cues in X.ROLE_CUES.items()}
    text = f"Plain words. {cue['method']} here. {cue['results']} there."
    made = spark.createDataFrame([(2, text), (3, None), (4, "")], "doc_id bigint, text string")
    got = dict(map(tuple, R.section_texts(made, ("whole", "method", "results", "background")).collect()))
    assert got == {8: text, 9: f"{cue['method']} here.", 10: f"{cue['results']} there.", 12: None, 16: ""}
    said = lambda *s: spark.range(1).select(R.reason_by_signals(*[F.lit(x) for x in s])).head()[0]
    assert said(1.0, 1.0, 0.0, 0.0) == "high keyword overlap with query terms" and said(0.0, 1.0, 0.0, 0.2).startswith("strong term") and said(1.0, 1.0, 1.0, 1.0).startswith("high semantic")
