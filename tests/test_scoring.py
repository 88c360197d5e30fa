"""Scores by blocks equal those by rows, over any cut into blocks, and no row a pair of a query and a document is shuffled."""

import pickle
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslane.operators import retrieval as T
from corpuslane.operators import scoring as B

SCHEMA = "query_id bigint, doc_id bigint"


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 25))) for _ in range(240)]
    texts[50:60] = texts[40:50]  # equal scores
    docs = spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id bigint, text string")
    index = T.build_index(docs)
    queries = T.documents_as_queries(index, F.col("doc_id") % 10 == 0)
    pairs = T.lexical_scores(index, queries).cache()
    return index, queries, pairs, docs, docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "text")


@pytest.fixture(params=[(4096, 512), (37, 5)])
def blocks(made, request, monkeypatch):
    monkeypatch.setattr(B, "DOCS_PER_BLOCK", request.param[0])
    monkeypatch.setattr(B, "QUERIES_PER_BLOCK", request.param[1])
    monkeypatch.setattr(B, "MATCHES", request.param[1] * 10)
    return B.pack_blocks(*made[3:])


def lists(pairs):
    one = lambda c: pairs.where(F.col(c).isNotNull()).select("query_id", "doc_id", F.col(c).alias("score"), F.lit(c).alias("component"))
    return one("tfidf").unionByName(one("bm25"))


def rounded(df, *columns):
    return sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_heads_ranks_and_fusion_equal_whole_rankings(made, blocks):
    pairs = made[2]
    ranked = T.full_ranks(lists(pairs), ("query_id", "component"))
    assert rounded(B.heads(blocks, 7), "query_id", "doc_id", "component", "score", "rank") == rounded(ranked.where("rank <= 7"), "query_id", "doc_id", "component", "score", "rank")
    weights, columns = {"bm25": 0.6, "tfidf": 0.4}, ("query_id", "doc_id", "score", "bm25_rank", "tfidf_rank", "rank")
    for k in (1, 10):
        assert rounded(B.fused_by_rank(blocks, weights, k), *columns) == rounded(T.reciprocal_rank_fusion(ranked, weights, k), *columns)
    far = pairs.where("doc_id % 7 = 3").select("query_id", "doc_id")
    want = ranked.where("component = 'bm25' and doc_id % 7 = 3")
    assert rounded(B.stated_ranks(blocks, far, "bm25"), "query_id", "doc_id", "rank") == rounded(want, "query_id", "doc_id", "rank")


def test_scaled_fusion_and_leaders_equal_whole_rankings(made, blocks):
    scaled = T.min_max_columns(made[2], ("bm25", "tfidf"))
    want = T.top_k(scaled.select("query_id", "doc_id", (0.55 * F.col("bm25") + 0.45 * F.col("tfidf")).alias("score")), 10)
    columns = ("query_id", "doc_id", "score", "rank")
    assert rounded(B.fused_by_score(blocks, {"bm25": 0.55, "tfidf": 0.45}, 10), *columns) == rounded(want, *columns)
    two = scaled.select("query_id", "doc_id", F.col("bm25").alias("b"), F.col("tfidf").alias("t"))
    assert rounded(B.leaders(blocks, 5), "query_id", "doc_id", "b", "t") == rounded(T.may_lead(two, 5, "b", "t"), "query_id", "doc_id", "b", "t")


def test_pairs_stay_in_their_tasks(made, blocks):
    """What leaves the tasks is bounded by queries and k; before, every matching pair was stored."""
    queries, tasks = made[1].select("query_id").distinct().count(), blocks.docs.rdd.getNumPartitions()
    assert B.summarize(blocks, B.Heads(3)).count() <= 2 * 3 * queries * tasks
    assert made[2].count() > 20 * 2 * 3 * queries


def test_one_task_a_core_keeps_rows_of_all_queries(spark, made, monkeypatch):
    """Each task writes its best of every query, so four tasks a core wrote four times as much."""
    monkeypatch.setattr(B, "DOCS_PER_BLOCK", 7)
    assert B.pack_blocks(*made[3:]).docs.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_sections_of_a_document_share_a_block(made, spark, monkeypatch):
    monkeypatch.setattr(B, "DOCS_PER_BLOCK", 7)
    weights, (index, _, _, docs, queries) = (0.6, 0.3, 0.1), made
    key = F.col("doc_id")
    sections = docs.where("doc_id % 3 <> 1 or doc_id % 2 = 0")
    blocks = B.pack_blocks(sections, queries, together=3)
    scored = T.tfidf(T.build_index(sections), queries, None).groupBy("query_id", F.floor(key / 3).alias("doc_id")).agg(F.sum(F.col("score") * F.element_at(F.array(*[F.lit(w) for w in weights]), (key % 3 + 1).cast("int"))).alias("score"))
    columns = ("query_id", "doc_id", "score", "rank")
    assert rounded(B.best_sections(blocks, weights, 5), *columns) == rounded(T.top_k(scored, 5), *columns)


def test_nothing_to_search(spark, made):
    none = B.pack_blocks(made[3], made[4].where("false"))
    assert B.heads(B.pack_blocks(made[3].where("false"), made[4]), 3).count() == 0
    assert B.heads(none, 3).count() == 0 and B.fused_by_rank(none, {"bm25": 0.6, "tfidf": 0.4}, 3).count() == 0
    assert B.fused_by_score(none, {"bm25": 0.6, "tfidf": 0.4}, 3).count() == 0 and B.leaders(none, 3).count() == 0


def test_blocks_take_little_disk(spark, made, monkeypatch):
    """No row a term and block or a query and term is stored, and the queries are stored compressed."""
    stored, real = [], B.cut_lineage

    def cut(df):
        stored.append(df.columns)
        return real(df)

    monkeypatch.setattr(B, "cut_lineage", cut)
    blocks = B.pack_blocks(*made[3:])
    assert stored == [["_d", "_docs"], ["term", "df", "_term"], ["_d", "_docs"], ["_q", "_queries"]]
    rows = blocks.queries.collect()
    assert sum(len(r["_queries"]) for r in rows) < sum(len(pickle.dumps(B._unpack(r["_queries"]), protocol=5)) for r in rows)


def test_only_queries_that_are_asked_about_are_scored(made, blocks):
    """Ranks behind the heads are open for few queries; before, all queries were scored once more to count them."""
    d = B.read_docs(blocks.docs.head()["_docs"], blocks.corpus)
    q = B._unpack(blocks.queries.head()["_queries"])
    more = {"query_id": q["ids"][[3, 1, 3]], "doc_id": d["ids"][:3], "_row": np.array([3, 1, 3])}
    few, asked = B.Above().narrow(q, more)
    assert few["ids"].tolist() == q["ids"][[1, 3]].tolist() and asked["_row"].tolist() == [1, 0, 1]
    for got, want in zip(B.scores(few, d), B.scores(q, d)):
        assert np.allclose(got, want[[1, 3]], rtol=0, atol=1e-12)


def test_blocks_are_dealt_in_turn(made, monkeypatch):
    """Dealt by the hash of their numbers, some tasks had half as many blocks again as others."""
    monkeypatch.setattr(B, "DOCS_PER_BLOCK", 2)
    sizes = [len(x) for x in B.pack_blocks(*made[3:]).docs.rdd.glom().collect()]
    assert sum(sizes) >= 120 and max(sizes) - min(sizes) <= len(sizes)


def test_heads_are_merged_now_and_then():
    """Sorting all heads anew for every block took a quarter of the time; rows and bars stay the same."""
    rng = np.random.default_rng(3)
    best, merges = B.Best(4, 5, 1), []
    real = best.merge
    best.merge = lambda: (merges.append(1), real())
    blocks = [rng.integers(0, 50, (4, 30)) / 7 for _ in range(40)]
    for i, m in enumerate(blocks):
        best.offer(m, np.arange(30) + 30 * i, [m])
    assert len(merges) < 20
    every = np.concatenate(blocks, axis=1)
    row, ids, score, values = best.rows()
    want = np.argsort(-np.round(every, 9), axis=1, kind="stable")[:, :5]
    assert ids.reshape(4, 5).tolist() == want.tolist() and np.allclose(score.reshape(4, 5), np.take_along_axis(every, want, axis=1)) and np.allclose(values[0], score)


@pytest.mark.parametrize("size", [(4096, 512, 1), (37, 5, 11)])
def test_ranks_of_documents_that_share_a_label(spark, made, size, monkeypatch):
    """Before, a row a pair went along with every block of documents; now a query has one row, whatever its labels hold."""
    monkeypatch.setattr(B, "DOCS_PER_BLOCK", size[0])
    monkeypatch.setattr(B, "QUERIES_PER_BLOCK", size[1])
    labels = F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("big"))).when(F.col("doc_id") % 10 == 1, F.array(F.lit("big"), F.lit("small"))).when(F.col("doc_id") % 5 == 0, F.array(F.lit("small")))
    docs = made[3].withColumn("labels", labels)
    asked = docs.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), "labels").unionByName(spark.createDataFrame([(7, None), (9999, ["small"])], "query_id bigint, labels array<string>"))
    blocks = B.pack_blocks(docs, made[4], least=size[2])
    assert blocks.many >= size[2]
    ranked = T.full_ranks(lists(made[2]), ("query_id", "component")).where("component = 'bm25'").select("query_id", "doc_id", "rank")
    one = lambda df, key: df.select(F.col(key).alias(key), F.explode("labels").alias("label"))
    pairs = one(asked, "query_id").join(one(docs, "doc_id"), "label").select("query_id", "doc_id").distinct()
    pairs = pairs.unionByName(asked.where("labels is null").join(docs, F.col("query_id") == F.col("doc_id")).select("query_id", "doc_id"))
    want = pairs.join(ranked, ["query_id", "doc_id"], "left").fillna(0, ["rank"])
    got = B.label_ranks(blocks, asked, "bm25")
    columns = ("query_id", "doc_id", "rank")
    assert rounded(got, *columns) == rounded(want, *columns) and got.where("rank = 0").count() > 0 and got.count() > 20 * asked.count()


def test_equal_scores_are_counted_by_id():
    known, fall = np.array([30, 10, 20, 40]), np.array([-2.0, -1.0, -1.0, -1.0])
    order, before = np.array([0, 1, 2, 3], dtype=np.int32), np.zeros(5, dtype=np.int32)
    B.LabelRanks.count(np.array([-1.0, -1.0, -1.0, -2.0, -1.5, -0.5, -2.0]), np.array([5, 15, 45, 29, 1, 1, 31]), fall, known, order, before)
    assert before.tolist() == [1, 3, 1, 0, 2]


def test_no_words_are_known(spark, made):
    docs = made[3].withColumn("labels", F.array(F.lit("a"))).where("text is null or doc_id < 3")
    asked = docs.where("text is null").select(F.col("doc_id").alias("query_id"), "labels")
    blocks = B.pack_blocks(docs, docs.where("text is null").select(F.col("doc_id").alias("query_id"), "text"))
    got = B.label_ranks(blocks, asked, "bm25").collect()
    assert len(got) == asked.count() * docs.count() > 0 and {r["rank"] for r in got} == {0}
