"""TF-IDF and Okapi scores of all pairs of a query and a document that share a word, block by block.

Documents and queries are packed into blocks of bounded size. Every block of queries meets every block of documents in a
task, which makes the two score matrices and keeps only what a summary asks for: the best of each query, its extremes,
scores of stated pairs, or how many documents stand above them. No row a pair leaves a task, so disk grows with documents
and queries, not with their product. Terms in many documents go through a matrix product, all others through their
postings. Scores are those of :func:`retrieval.lexical_scores`, rounded in the same way.
"""

from __future__ import annotations

import math
import pickle
import tempfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import text as X
from corpuslane.operators.retrieval import DIGITS, may_lead, query_terms, top_k
from corpuslane.runtime import cut_lineage, spread

DOCS_PER_BLOCK, QUERIES_PER_BLOCK = 2048, 512
#: Blocks of queries whose states a task holds at once, and rows whose words become Python strings at once.
HELD, ROWS = 4, 1024
#: A term in more than this share of the documents goes through the matrix product.
COMMON = 0.05
#: Scores below this round to 0.
LEAST = 0.5 * 10.0**-DIGITS
#: Matches of rare terms that are expanded at once.
MATCHES = 2_000_000
#: Pairs with a shared label that a block of queries has about, where their ranks are asked for.
PAIRS = 4_000_000
SIDES = ("tfidf", "bm25")


@dataclass
class Blocks:
    docs: DataFrame  # _d, _docs
    queries: DataFrame  # _q, _queries
    many: int  # blocks of queries
    corpus: tuple[float, float, float, float]  # documents, their mean length, k1, b


def _block(key: str, many: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(many)).cast("int")


def _dealt(tasks: int, key: str = "_d") -> Column:
    """Another number for each block, whose hash deals blocks to ``tasks`` in turn; hashes of the numbers as they are give some tasks half as many again."""
    some, number = 16 * tasks, F.col(key).cast("bigint")
    turn = F.pmod(F.shiftright(number, 32) + number.bitwiseAND((1 << 32) - 1), F.lit(tasks))
    numbers = F.sequence(number * some, number * some + some - 1)
    return F.coalesce(F.get(F.filter(numbers, lambda x: F.pmod(F.hash(x), F.lit(tasks)) == turn), F.lit(0)), number * some)


def _labels(rows: list) -> tuple[np.ndarray, np.ndarray, list]:
    """(row, code) of all labels of the rows, and what the codes stand for."""
    place = np.repeat(np.arange(len(rows)), [0 if x is None else len(x) for x in rows])
    code, known = pd.factorize(np.asarray([y for x in rows if x is not None for y in x], dtype=object))
    return place, code, list(known)


def in_slices(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]):
    """``run`` for mapInArrow over a few rows at once, as lists of words take many times their room as Python strings."""

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for made in run(batch.slice(at, ROWS).to_pandas() for batch in batches for at in range(0, batch.num_rows, ROWS)):
            yield pa.RecordBatch.from_pandas(made, preserve_index=False)

    return sliced


def _arranged(term: np.ndarray, at: np.ndarray, common: np.ndarray, values: list[np.ndarray]) -> dict:
    """Common terms by column of a matrix, the others sorted by term."""
    columns, column = np.unique(term[common], return_inverse=True)
    order = np.argsort(term[~common], kind="stable")
    return {
        "columns": columns, "row": at[common], "column": column, "dense": [x[common] for x in values],
        "terms": term[~common][order], "at": at[~common][order], "rare": [x[~common][order] for x in values],
    }


def _counted(docs: DataFrame, analyzer, size: int, together: int = 1) -> DataFrame:
    """(_d, _docs): documents in the order of their partitions, with the counts of their terms by a vocabulary a block.

    Neighbours whose ids are equal when divided by ``together`` share a block.
    """

    labelled = "labels" in docs.columns

    def block(number: int, ids: list, words: list, labels: list) -> pd.DataFrame:
        length = np.asarray([len(w) for w in words], dtype=np.int64)
        code, vocabulary = pd.factorize(np.concatenate([np.asarray(w, dtype=object) for w in words]) if length.sum() else np.zeros(0, dtype=object))
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        many = max(1, len(vocabulary))
        pairs, tf = np.unique(np.repeat(place, length) * many + code, return_counts=True)
        least = lambda x: x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        packed = {"ids": np.asarray(ids, dtype=np.int64)[order], "dl": least(length[order]), "terms": least(np.bincount(pairs // many, minlength=len(ids))), "code": least(pairs % many), "tf": least(tf), "words": list(vocabulary)}
        if labelled:
            packed["labels"] = _labels([labels[i] for i in order])
        return pd.DataFrame({"_d": [number], "_docs": [_pack(packed)]})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, ids, words, labels = TaskContext.get().partitionId() << 32, [], [], []
        for frame in frames:
            ids += frame["doc_id"].tolist()
            words += frame["w"].tolist()
            labels += frame["labels"].tolist() if labelled else []
            # The last ones may have neighbours in the next frame.
            while len(ids) >= size + together:
                end = size
                while ids[end] // together == ids[end - 1] // together:
                    end += 1
                yield block(number, ids[:end], words[:end], labels[:end])
                number, ids, words, labels = number + 1, ids[end:], words[end:], labels[end:]
        if ids:
            yield block(number, ids, words, labels)

    made = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(analyzer(F.col("text")), F.array().cast("array<string>")).alias("w"), *(["labels"] if labelled else []))
    return cut_lineage(made.mapInArrow(in_slices(run), "_d bigint, _docs binary"))


def _pack(made: dict) -> bytes:
    return zlib.compress(pickle.dumps(made, protocol=5), 6)


def _unpack(raw: bytes) -> dict:
    return pickle.loads(zlib.decompress(raw))


def pack_blocks(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, analyzer=X.content_tokens, together: int = 1, least: int = 1) -> Blocks:
    """Blocks of documents (doc_id, text; one row an id) and of queries (query_id, text; one row an id), stored.

    There are ``least`` blocks of queries or more. Documents may have ``labels``, an array of strings.
    With ``together`` above 1, ids that are equal when divided by it are in one block.
    Terms are counted inside the blocks; between the tasks move only the words of each block with their document counts.
    """
    if together > 1:
        group = F.floor(F.col("doc_id") / together)
        docs = docs.repartition(docs.sparkSession.sparkContext.defaultParallelism * 2, group).sortWithinPartitions("doc_id")
    else:
        docs = spread(docs, tasks_per_core=1)
    counted = _counted(docs, analyzer, DOCS_PER_BLOCK, together)

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, raw in zip(frame["_d"], frame["_docs"]):
                d = _unpack(raw)
                n = len(d["words"])
                yield pd.DataFrame({"_d": np.full(n, number), "code": np.arange(n), "term": pd.Series(d["words"], dtype=object), "df": np.bincount(d["code"], minlength=n)})

    def sizes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for raw in frame["_docs"]:
                d = _unpack(raw)
                yield pd.DataFrame({"n": [len(d["ids"])], "dl": [int(d["dl"].sum(dtype=np.int64))]})

    # Read from the blocks twice, as its rows take more room than the blocks.
    known = counted.mapInPandas(words, "_d bigint, code int, term string, df bigint")
    total = counted.mapInPandas(sizes, "n bigint, dl bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl"), F.count("*").alias("blocks")).head()
    n, avgdl = float(total.n), total.dl / max(1, total.n) or 1.0
    raw = F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = cut_lineage(known.groupBy("term").agg(F.sum("df").alias("df")).withColumn("_term", F.monotonically_increasing_id()))
    mean = terms.agg(F.avg(raw).alias("mean")).head().mean or 0.0
    # A task keeps k rows a query, so there is one a core.
    tasks = min(total.blocks or 1, docs.sparkSession.sparkContext.defaultParallelism)
    counted, known = (x.withColumn("_d", _dealt(tasks)) for x in (counted, known))
    numbered = known.join(terms.withColumnRenamed("df", "_df"), "term").repartition(tasks, "_d").groupBy("_d").agg(F.array_sort(F.collect_list(F.struct("code", "_term", "_df"))).alias("_c"))

    def arrange(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, raw_, term, df in zip(frame["_d"], frame["_docs"], frame["_term"], frame["_df"]):
                d = _unpack(raw_)
                d["words"] = []
                d["term"], d["df"] = (np.zeros(0, dtype=np.int64) if x is None else np.asarray(x, dtype=np.int64) for x in (term, df))
                yield pd.DataFrame({"_d": [number], "_docs": [_pack(d)]})

    # Both sides are dealt alike, so the blocks move once.
    sides = counted.repartition(tasks, "_d").join(numbered, "_d", "left").select("_d", "_docs", F.transform("_c", lambda x: x["_term"]).alias("_term"), F.transform("_c", lambda x: x["_df"]).alias("_df"))
    packed = cut_lineage(sides.mapInPandas(arrange, "_d bigint, _docs binary"))
    q = query_terms(queries, analyzer).join(terms, "term").withColumns({"_idf": F.log((1 + n) / (1 + F.col("df"))) + 1, "_raw": F.when(raw < 0, 0.25 * mean).otherwise(raw), "_common": F.col("df") > COMMON * n})
    q = q.select("query_id", "_term", "_common", "qtf", "_idf", "_raw")
    some = max(-(-queries.select("query_id").distinct().count() // QUERIES_PER_BLOCK), least)

    def asked(frame: pd.DataFrame) -> pd.DataFrame:
        ids, at = np.unique(frame["query_id"].to_numpy(), return_inverse=True)
        qtf, idf = frame["qtf"].to_numpy(dtype=np.float64), frame["_idf"].to_numpy()
        norm = np.sqrt(np.bincount(at, (qtf * idf) ** 2, minlength=len(ids)))
        values = [qtf * idf * idf / norm[at], qtf * frame["_raw"].to_numpy() * (k1 + 1)]
        made = {"ids": ids} | _arranged(frame["_term"].to_numpy(), at, frame["_common"].to_numpy(dtype=bool), values)
        return pd.DataFrame({"_q": [int(frame["_q"].iloc[0])], "_queries": [_pack(made)]})

    stored = cut_lineage(q.withColumn("_q", _block("query_id", some)).groupBy("_q").applyInPandas(asked, "_q int, _queries binary")).coalesce(1)
    return Blocks(packed, stored, some, (n, avgdl, k1, b))


def read_docs(raw: bytes, corpus: tuple[float, float, float, float]) -> dict:
    """The block as the kernel wants it: parts of the cosine and of Okapi that belong to a document and a term."""
    n, avgdl, k1, b = corpus
    d = _unpack(raw)
    at, code, tf = np.repeat(np.arange(len(d["ids"])), d["terms"]), d["code"].astype(np.int64), d["tf"].astype(np.float64)
    kept = {c: d[c] for c in ("ids", "labels") if c in d}
    if not len(code):
        return kept | _arranged(code, at, np.zeros(0, dtype=bool), [tf, tf])
    df = d["df"][code]
    norm = np.sqrt(np.bincount(at, (tf * (np.log((1 + n) / (1 + df)) + 1)) ** 2, minlength=len(d["ids"])))
    values = [tf / norm[at], tf / (tf + k1 * (1 - b + b * d["dl"].astype(np.float64)[at] / avgdl))]
    return kept | _arranged(d["term"][code], at, df > COMMON * n, values)


def scores(q: dict, d: dict) -> list[np.ndarray]:
    """The unrounded score matrices (queries by documents) of two blocks, one a side of the queries; 0 where nothing is shared."""
    nq, nd = len(q["ids"]), len(d["ids"])
    columns = d["columns"]

    def matrix(x: dict, side: int, rows: int) -> np.ndarray:
        place = np.searchsorted(columns, x["columns"])
        known = (place < len(columns)) & (columns[np.minimum(place, len(columns) - 1)] == x["columns"]) if len(columns) else np.zeros(len(x["columns"]), dtype=bool)
        keep = known[x["column"]]
        m = np.zeros((rows, len(columns)))
        m[x["row"][keep], place[x["column"][keep]]] = x["dense"][side][keep]
        return m

    sides = range(len(q["rare"]))
    # The matrices of a block of documents serve all blocks of queries.
    if "matrices" not in d:
        d["matrices"] = [matrix(d, s, nd).T for s in sides]
    out = [(matrix(q, s, nq) @ d["matrices"][s]).ravel() for s in sides]
    low, high = np.searchsorted(q["terms"], d["terms"], "left"), np.searchsorted(q["terms"], d["terms"], "right")
    hit = np.flatnonzero(high > low)
    low, count = low[hit], (high - low)[hit]
    ends = np.cumsum(count)
    begin = 0
    while begin < len(hit):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + MATCHES, "right")))
        n, first = count[begin:end], low[begin:end]
        of_d = np.repeat(hit[begin:end], n)
        of_q = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        flat = q["at"][of_q].astype(np.int64) * nd + d["at"][of_d]
        for s in sides:
            out[s] += np.bincount(flat, weights=q["rare"][s][of_q] * d["rare"][s][of_d], minlength=nq * nd)
        begin = end
    return [m.reshape(nq, nd) for m in out]


def only(q: dict, rows: np.ndarray) -> dict:
    """The block of the queries (or documents) at ``rows`` alone."""
    place = np.full(len(q["ids"]), -1)
    place[rows] = np.arange(len(rows))
    dense, rare = place[q["row"]] >= 0, place[q["at"]] >= 0
    columns, column = np.unique(q["column"][dense], return_inverse=True)
    return {
        "ids": q["ids"][rows], "columns": q["columns"][columns], "row": place[q["row"][dense]], "column": column, "dense": [x[dense] for x in q["dense"]],
        "terms": q["terms"][rare], "at": place[q["at"][rare]], "rare": [x[rare] for x in q["rare"]],
    }


class Heads:
    """(query_id, doc_id, side, tfidf, bm25): the k best of each query on each side, with both scores (0: none)."""

    def __init__(self, k: int):
        self.k = k
        self.schema = "query_id bigint, doc_id bigint, side int, tfidf double, bm25 double"

    def start(self, q: dict, more: dict | None) -> list:
        return [Best(len(q["ids"]), self.k) for _ in SIDES]

    def step(self, state: list, q: dict, more: dict | None, d: dict, m: list[np.ndarray]) -> None:
        for side, best in enumerate(state):
            best.offer(m[side], d["ids"], [m[0], m[1]], LEAST)

    def finish(self, state: list, q: dict) -> Iterator[pd.DataFrame]:
        for side, best in enumerate(state):
            row, ids, _, values = best.rows()
            yield pd.DataFrame({"query_id": q["ids"][row], "doc_id": ids, "side": np.int32(side), "tfidf": values[0], "bm25": values[1]})


class Best:
    """The k greatest rounded scores of each row over many blocks, ties to the smaller id, with values beside them."""

    def __init__(self, rows: int, k: int, beside: int = 2):
        self.k, self.n = k, rows
        self.bar = np.full(rows, -np.inf)
        self.merged: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((beside, 0))]
        self.waiting: list[list[np.ndarray]] = []

    def offer(self, m: np.ndarray, ids: np.ndarray, values: list[np.ndarray], least: float = -np.inf) -> None:
        bar = np.maximum(self.bar - 2 * LEAST, least)
        if m.shape[1] > self.k:
            # The k-th best of this block alone is a bar, too; only for rows that have no bar of k rows yet.
            fresh = np.flatnonzero(~np.isfinite(self.bar))
            if len(fresh):
                bar[fresh] = np.maximum(bar[fresh], np.partition(m[fresh], m.shape[1] - self.k, axis=1)[:, m.shape[1] - self.k] - 2 * LEAST)
        flat = np.flatnonzero(m >= bar[:, None])
        if not len(flat):
            return
        row, col = np.divmod(flat, m.shape[1])
        new = np.stack([v[row, col] for v in values]) if values else np.zeros((0, len(row)))
        self.waiting.append([row, ids[col], np.round(m.ravel()[flat], DIGITS), new])
        # All are sorted anew, so a few that pass an old bar wait for more; rows without a bar don't.
        if sum(len(x[0]) for x in self.waiting) > len(self.merged[0]) // 2 or not np.isfinite(self.bar).all():
            self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        row, doc, score, beside = (np.concatenate(x, axis=-1) for x in zip(self.merged, *self.waiting))
        self.waiting = []
        order = np.lexsort((doc, -score, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, "left")
        order, row, place = order[place < self.k], row[place < self.k], place[place < self.k]
        self.merged = [row, doc[order], score[order], beside[:, order]]
        full = place == self.k - 1
        self.bar[row[full]] = self.merged[2][full]

    @property
    def kept(self) -> list[np.ndarray]:
        self.merge()
        return self.merged

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        row, ids, score, values = self.kept
        return row, ids, score, np.round(values, DIGITS)


class Ends:
    """(query_id, lo_tfidf, hi_tfidf, lo_bm25, hi_bm25): the extremes of the positive scores."""

    schema = "query_id bigint, lo_tfidf double, hi_tfidf double, lo_bm25 double, hi_bm25 double"

    def start(self, q: dict, more: dict | None) -> np.ndarray:
        return np.stack([np.full(len(q["ids"]), x) for x in (np.inf, -np.inf) * 2])

    def step(self, state: np.ndarray, q: dict, more: dict | None, d: dict, m: list[np.ndarray]) -> None:
        for side in range(2):
            np.minimum(state[2 * side], np.where(m[side] >= LEAST, m[side], np.inf).min(axis=1), out=state[2 * side])
            np.maximum(state[2 * side + 1], m[side].max(axis=1), out=state[2 * side + 1])

    def finish(self, state: np.ndarray, q: dict) -> Iterator[pd.DataFrame]:
        known = [np.where(np.isfinite(x) & (x >= LEAST), np.round(x, DIGITS), np.nan) for x in state]
        yield pd.DataFrame(dict(zip(["query_id", "lo_tfidf", "hi_tfidf", "lo_bm25", "hi_bm25"], [q["ids"], *known])))


class Sections:
    """(query_id, doc_id, score): the k best by TF-IDF over the sections of each document, weighted by their place.

    The key of a section is a document's id times the number of weights, plus its place.
    """

    schema = "query_id bigint, doc_id bigint, score double"

    def __init__(self, weights: tuple[float, ...], k: int):
        self.weights, self.k = weights, k

    def start(self, q: dict, more: dict | None) -> Best:
        return Best(len(q["ids"]), self.k)

    def step(self, state: Best, q: dict, more: dict | None, d: dict, m: list[np.ndarray]) -> None:
        doc, place = np.divmod(d["ids"], len(self.weights))
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        total = np.add.reduceat(np.round(m[0], DIGITS) * np.asarray(self.weights)[place], first, axis=1)
        state.offer(total, doc[first], [total, total], LEAST)

    def finish(self, state: Best, q: dict) -> Iterator[pd.DataFrame]:
        row, ids, score, _ = state.rows()
        yield pd.DataFrame({"query_id": q["ids"][row], "doc_id": ids, "score": score})


def scaled(m: list[np.ndarray], more: dict) -> list[np.ndarray]:
    """Both sides scaled to 0..1 by the extremes in ``more``, a missing score as 0, as in min_max_columns."""
    out = []
    for side, name in enumerate(SIDES):
        lo, hi = more[f"lo_{name}"][:, None], more[f"hi_{name}"][:, None]
        span = hi - lo
        x = (np.round(m[side], DIGITS) - lo) / np.where(span < 1e-9, 1.0, span)
        out.append(np.where(m[side] >= LEAST, np.where(span < 1e-9, 0.5, x), 0.0))
    return out


class Fused:
    """(query_id, doc_id, score): the k best by a weighted sum of the scaled sides; needs the extremes."""

    schema = "query_id bigint, doc_id bigint, score double"

    def __init__(self, weights: dict[str, float], k: int):
        self.weights, self.k = weights, k

    def start(self, q: dict, more: dict) -> Best:
        return Best(len(q["ids"]), self.k)

    def step(self, state: Best, q: dict, more: dict, d: dict, m: list[np.ndarray]) -> None:
        t, b = scaled(m, more)
        total = self.weights["bm25"] * b + self.weights["tfidf"] * t
        total[(m[0] < LEAST) & (m[1] < LEAST)] = -np.inf
        state.offer(total, d["ids"], [total, total], -1.0)

    def finish(self, state: Best, q: dict) -> Iterator[pd.DataFrame]:
        row, ids, score, _ = state.rows()
        yield pd.DataFrame({"query_id": q["ids"][row], "doc_id": ids, "score": score})


class Leaders:
    """(query_id, doc_id, b, t): scaled sides of the documents that some weight may bring among the k best of a query.

    As in may_lead, k documents with both sides above the greater side of another shut it out; needs the extremes.
    """

    schema = "query_id bigint, doc_id bigint, b double, t double"

    def __init__(self, k: int):
        self.k = k

    def start(self, q: dict, more: dict) -> tuple[Best, list]:
        return Best(len(q["ids"]), self.k), []

    def step(self, state: tuple[Best, list], q: dict, more: dict, d: dict, m: list[np.ndarray]) -> None:
        best, kept = state
        t, b = scaled(m, more)
        none = (m[0] < LEAST) & (m[1] < LEAST)
        low, high = np.minimum(b, t), np.maximum(b, t)
        low[none], high[none] = -np.inf, -np.inf
        best.offer(low, d["ids"], [low, low], -1.0)
        flat = np.flatnonzero(high >= np.maximum(best.bar, -1.0)[:, None] - 1e-8)
        row, col = np.divmod(flat, m[0].shape[1])
        kept.append((row, d["ids"][col], b.ravel()[flat], t.ravel()[flat]))
        if len(kept) > 8:
            self.shrink(state)

    def shrink(self, state: tuple[Best, list]) -> None:
        best, kept = state
        row, ids, b, t = (np.concatenate(x) for x in zip(*kept))
        still = np.maximum(b, t) >= best.bar[row] - 1e-8
        kept[:] = [(row[still], ids[still], b[still], t[still])]

    def finish(self, state: tuple[Best, list], q: dict) -> Iterator[pd.DataFrame]:
        if state[1]:
            self.shrink(state)
            row, ids, b, t = state[1][0]
            yield pd.DataFrame({"query_id": q["ids"][row], "doc_id": ids, "b": b, "t": t})


class Stated:
    """(query_id, doc_id, tfidf, bm25): the scores of the pairs in ``more`` (0: none)."""

    schema = "query_id bigint, doc_id bigint, tfidf double, bm25 double"

    def start(self, q: dict, more: dict) -> list:
        return []

    def step(self, state: list, q: dict, more: dict, d: dict, m: list[np.ndarray]) -> None:
        col = np.searchsorted(d["ids"], more["doc_id"])
        here = (d["ids"][np.minimum(col, len(d["ids"]) - 1)] == more["doc_id"]).nonzero()[0]
        row, col = more["_row"][here], col[here]
        state.append((q["ids"][row], more["doc_id"][here], np.round(m[0][row, col], DIGITS), np.round(m[1][row, col], DIGITS)))

    def finish(self, state: list, q: dict) -> Iterator[pd.DataFrame]:
        for part in state:
            yield pd.DataFrame(dict(zip(["query_id", "doc_id", "tfidf", "bm25"], part)))


class Above:
    """(query_id, doc_id, above_tfidf, above_bm25): how many documents stand above each pair in ``more`` by its scores.

    Counts of a task; they are summed over all. Sides that are not asked for count 0.
    """

    schema = "query_id bigint, doc_id bigint, above_tfidf bigint, above_bm25 bigint"

    def __init__(self, sides: tuple[str, ...] = SIDES):
        self.sides = sides

    def start(self, q: dict, more: dict) -> np.ndarray:
        return np.zeros((2, len(more["doc_id"])), dtype=np.int64)

    def narrow(self, q: dict, more: dict) -> tuple[dict, dict]:
        rows, at = np.unique(more["_row"], return_inverse=True)
        return only(q, rows), more | {"_row": at}

    def step(self, state: np.ndarray, q: dict, more: dict, d: dict, m: list[np.ndarray]) -> None:
        for side, name in enumerate(SIDES):
            asked = np.flatnonzero(more[name] >= LEAST) if name in self.sides else np.zeros(0, dtype=np.int64)
            if not len(asked):
                continue
            row, score, doc = more["_row"][asked], more[name][asked], more["doc_id"][asked]
            order = np.argsort(row, kind="stable")
            rows, firsts = np.unique(row[order], return_index=True)
            for r, mine in zip(rows, np.split(order, firsts[1:])):
                # Equal scores go by id: ids are in order, so a stable sort leaves them so.
                have = np.round(m[side][r], DIGITS)
                if len(mine) > 8:
                    falling = np.argsort(-have, kind="stable")
                    sorted_ = -have[falling]
                    left, right = np.searchsorted(sorted_, -score[mine], "left"), np.searchsorted(sorted_, -score[mine], "right")
                    state[side][asked[mine]] += left + [int((d["ids"][falling[a:z]] < x).sum()) for a, z, x in zip(left, right, doc[mine])]
                else:
                    for i in mine:
                        state[side][asked[i]] += np.count_nonzero(have > score[i]) + np.count_nonzero((have == score[i]) & (d["ids"] < doc[i]))

    def finish(self, state: np.ndarray, q: dict) -> Iterator[pd.DataFrame]:
        yield state


class LabelRanks:
    """(query_id, doc_id, rank): of the documents that share a label with the query, or of its own one if it has no labels, in the whole ranking of a side; 0 where they are not in it.

    Scores of those documents alone come first; the others are then counted where they stand among them. No pair leaves
    its task but for the results.
    """

    schema = "query_id bigint, doc_id bigint, rank bigint"

    def __init__(self, side: str):
        self.side = SIDES.index(side)

    def one(self, x: dict) -> dict:
        return x | {c: [x[c][self.side]] for c in ("dense", "rare")}

    @staticmethod
    def places(d: dict, keys: list) -> dict[int, np.ndarray]:
        """The rows of a block that each key (an id, or labels) has there."""
        place, code, names = d["labels"]
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(len(names) + 1))
        of = {name: place[order[bounds[i] : bounds[i + 1]]] for i, name in enumerate(names)}
        out = {}
        for k, key in enumerate(keys):
            if isinstance(key, tuple):
                mine = [of[x] for x in key if x in of]
                if mine:
                    out[k] = np.unique(np.concatenate(mine))
            else:
                at = int(np.searchsorted(d["ids"], key))
                if at < len(d["ids"]) and d["ids"][at] == key:
                    out[k] = np.asarray([at])
        return out

    def run(self, q: dict | None, more: dict, docs: Callable[[], Iterator[dict]]) -> Iterator[pd.DataFrame]:
        none = np.zeros(0, dtype=np.int64)
        q = self.one(q) if q is not None else {"ids": none} | _arranged(none, none, none.astype(bool), [none.astype(np.float64)])
        row = {int(x): i for i, x in enumerate(q["ids"])}
        alike: dict = {}
        for query, labels in zip(more["query_id"].tolist(), more["labels"]):
            alike.setdefault(tuple(sorted(set(labels))) if labels is not None and len(labels) else query, []).append(query)
        keys, queries = list(alike), list(alike.values())
        # Queries without known words have no row.
        rows = [np.asarray([row[x] for x in some if x in row], dtype=np.int64) for some in queries]
        ids: list[list[np.ndarray]] = [[] for _ in keys]
        have: list[list[np.ndarray]] = [[] for _ in keys]
        for d in docs():
            here = self.places(d, keys)
            if here:
                some = np.unique(np.concatenate(list(here.values())))
                m = np.round(scores(q, only(self.one(d), some))[0], DIGITS)
                for k, at in here.items():
                    ids[k].append(d["ids"][at])
                    have[k].append(m[np.ix_(rows[k], np.searchsorted(some, at))])
        known, falling, order, before = [], [], [], []
        for k in range(len(keys)):
            known.append(np.concatenate(ids[k]) if ids[k] else none)
            mine = np.concatenate(have[k], axis=1) if have[k] else np.zeros((len(rows[k]), 0))
            have[k] = []
            order.append([np.lexsort((known[k], -x)).astype(np.int32)[: np.count_nonzero(x >= LEAST)] for x in mine])
            falling.append([-x[o] for x, o in zip(mine, order[k])])
            before.append([np.zeros(len(o) + 1, dtype=np.int32) for o in order[k]])
        for d in docs() if len(row) else ():
            here = self.places(d, keys)
            m = -np.round(scores(q, self.one(d))[0], DIGITS)
            for k, at in here.items():
                # These have their places already.
                m[np.ix_(rows[k], at)] = np.inf
            for k in range(len(keys)):
                for r, fall, o, count in zip(rows[k], falling[k], order[k], before[k]):
                    if len(fall):
                        column = np.flatnonzero(m[r] <= fall[-1])
                        self.count(m[r][column], d["ids"][column], fall, known[k], o, count)
        for k, some in enumerate(queries):
            at = {int(q["ids"][r]): i for i, r in enumerate(rows[k])}
            for query in some:
                rank = np.zeros(len(known[k]), dtype=np.int64)
                if query in at:
                    o = order[k][at[query]]
                    rank[o] = np.arange(1, len(o) + 1) + np.cumsum(before[k][at[query]][:-1], dtype=np.int64)
                yield pd.DataFrame({"query_id": np.full(len(rank), query), "doc_id": known[k], "rank": rank})

    @staticmethod
    def count(x: np.ndarray, doc: np.ndarray, fall: np.ndarray, known: np.ndarray, order: np.ndarray, before: np.ndarray) -> None:
        """Counts documents (negative score, id) at the first of the ranked ones that they stand above; equal scores go by id."""
        low, high = np.searchsorted(fall, x, "left"), np.searchsorted(fall, x, "right")
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) // 2
            behind = known[order[middle]] < doc[open_]
            low[open_[behind]], high[open_[~behind]] = middle[behind] + 1, middle[~behind]
            open_ = open_[low[open_] < high[open_]]
        np.add.at(before, low, 1)


def summarize(blocks: Blocks, what, more: DataFrame | None = None) -> DataFrame:
    """The rows that the summary ``what`` keeps; ``more`` are rows (query_id, further numbers) that it reads beside a block."""
    corpus = blocks.corpus
    return over_blocks(blocks, what, more, lambda raw: read_docs(raw, corpus), lambda q, d: (scores(q, d),), isinstance(what, (Fused, Leaders)))


class Spool:
    """Blocks of documents as they come, in a file of the task, to be read again and again."""

    def __init__(self):
        self.file, self.at = tempfile.TemporaryFile(), {}

    def add(self, number: int, raw: bytes) -> None:
        if number not in self.at:
            self.at[number] = (self.file.seek(0, 2), len(raw))
            self.file.write(raw)

    def __iter__(self) -> Iterator[bytes]:
        for at, size in self.at.values():
            self.file.seek(at)
            yield self.file.read(size)


def over_blocks(blocks, what, more: DataFrame | None, read: Callable[[bytes], dict], kernel: Callable[[dict, dict], tuple], by_query: bool) -> DataFrame:
    """Hands what ``kernel`` makes of every block of queries and every block of documents to ``what``; with ``by_query``, ``more`` has a row a query.

    A task has some blocks of documents and ``HELD`` blocks of queries with their state; with ``what.run``, all blocks of
    documents and one of queries. Every block comes to a task once.
    """
    queries = blocks.queries
    alone = hasattr(what, "run")
    if more is not None:
        many = blocks.many

        def pack(frame: pd.DataFrame) -> pd.DataFrame:
            # In order, the ids take little room.
            frame = frame.sort_values([c for c in ("query_id", "doc_id") if c in frame.columns], ignore_index=True)
            return pd.DataFrame({"_q": [int(frame["_q"].iloc[0])], "_more": [_pack({c: frame[c].to_numpy() for c in frame.columns if c != "_q"})]})

        packed = more.withColumn("_q", _block("query_id", many)).groupBy("_q").applyInPandas(pack, "_q int, _more binary")
        queries = queries.join(packed, "_q", "right" if alone else "inner")
    else:
        queries = queries.withColumn("_more", F.lit(None).cast("binary"))

    def beside(q: dict, raw: bytes | None) -> dict | None:
        if raw is None:
            return None
        rows = _unpack(raw)
        at = np.searchsorted(q["ids"], rows["query_id"])
        known = q["ids"][np.minimum(at, len(q["ids"]) - 1)] == rows["query_id"]
        at = at[known]
        if not by_query:
            return {c: v[known] for c, v in rows.items()} | {"_row": at}
        out = {}
        for c, v in rows.items():
            v = np.stack(v) if v.dtype == object else v
            out[c] = np.full((len(q["ids"]), *v.shape[1:]), np.nan)
            out[c][at] = v[known]
        return out

    def held(qs: bytes, raw: bytes | None) -> list:
        q = _unpack(qs)
        more_ = beside(q, raw)
        # Queries that no row asks about are not scored.
        if more_ is not None and hasattr(what, "narrow"):
            q, more_ = what.narrow(q, more_)
        return [q, more_, what.start(q, more_)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked: dict[int, tuple] = {}
        spool = Spool()
        for frame in frames:
            for number, sent, qs, raw, place, ds in zip(frame["_q"], frame["_sent"], frame["_queries"], frame["_more"], frame["_d"], frame["_docs"]):
                if sent and number not in asked:
                    asked[number] = (qs, raw)
                if ds is not None:
                    spool.add(place, ds)
        if alone:
            for qs, raw in asked.values():
                yield from what.run(None if qs is None else _unpack(qs), _unpack(raw), lambda: map(read, spool))
            return
        known = [held(*x) for x in asked.values()]
        for ds in spool:
            d = read(ds)
            for q, more_, state in known:
                what.step(state, q, more_, d, *kernel(q, d))
        for q, more_, state in known:
            for part in what.finish(state, q):
                if isinstance(part, np.ndarray):
                    part = pd.DataFrame({"query_id": q["ids"][more_["_row"]], "doc_id": more_["doc_id"], "above_tfidf": part[0], "above_bm25": part[1]})
                yield part

    # Every block of queries meets every block of documents: parts of the documents go with parts of the queries. The first
    # block of a part brings the blocks of the other side along.
    parts = blocks.many if alone else -(-blocks.many // HELD)
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    docs = (blocks.docs.coalesce(1) if alone else blocks.docs).withColumn("_first", first)
    queries = queries.repartition(parts, _dealt(parts, "_q")).withColumn("_lead", first)
    pairs = docs.crossJoin(queries.hint("shuffle_replicate_nl")).where("_first or _lead")
    sent = [F.when(F.col("_first"), F.col(c)).alias(c) for c in ("_queries", "_more")]
    return pairs.select("_q", F.col("_first").alias("_sent"), *sent, "_d", F.when(F.col("_lead"), F.col("_docs")).alias("_docs")).mapInPandas(run, what.schema)


def heads(blocks: Blocks, k: int) -> DataFrame:
    """(query_id, doc_id, component, score, rank, tfidf, bm25): the k best of each query on each side."""
    found = summarize(blocks, Heads(k)).withColumn("component", F.element_at(F.array(*[F.lit(c) for c in SIDES]), F.col("side") + 1))
    found = found.withColumn("score", F.when(F.col("side") == 0, F.col("tfidf")).otherwise(F.col("bm25")))
    rank = F.row_number().over(Window.partitionBy("query_id", "component").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("side")


def fused_by_rank(blocks: Blocks, weights: dict[str, float], k: int, constant: int = 60) -> DataFrame:
    """:func:`retrieval.reciprocal_rank_fusion` of both whole rankings: (query_id, doc_id, score, a rank a side, rank).

    The k best of the heaviest side have at least its weight / (constant + k); a document that is further back than
    ``depth`` on both sides has less. Of the others only those whose open rank can matter are counted in whole rankings.
    """
    depth = math.ceil(sum(weights.values()) * (constant + k) / max(weights.values())) - constant
    share = lambda c, rank: F.lit(weights[c]) / (constant + rank)
    both = heads(blocks, depth).groupBy("query_id", "doc_id").agg(*[F.max(c).alias(c) for c in SIDES], *[F.max(F.when(F.col("component") == c, F.col("rank"))).alias(f"_{c}") for c in SIDES])
    open_ = {c: F.col(f"_{c}").isNull() & (F.col(c) >= LEAST) for c in SIDES}
    low = sum((F.when(F.col(f"_{c}").isNull(), 0.0).otherwise(share(c, F.col(f"_{c}"))) for c in SIDES), F.lit(0.0))
    high = sum((F.when(open_[c], share(c, F.lit(depth + 1))).otherwise(0.0) for c in SIDES), low)
    both = both.withColumns({"_low": low, "_high": high})
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("_low")))
    bar = F.max(F.when(F.col("_place") == k, F.col("_low"))).over(Window.partitionBy("query_id"))
    kept = cut_lineage(both.withColumn("_place", place).withColumn("_bar", bar).where(F.col("_bar").isNull() | (F.col("_high") >= F.col("_bar") - 1e-8)))
    asked = kept.where(open_["tfidf"] | open_["bm25"]).select("query_id", "doc_id", *[F.when(open_[c], F.col(c)).otherwise(0.0).alias(c) for c in SIDES])
    if asked.isEmpty():
        counted = asked.select("query_id", "doc_id", *[F.lit(0).cast("bigint").alias(f"above_{c}") for c in SIDES])
    else:
        counted = above(blocks, asked)
    rank = lambda c: F.coalesce(f"_{c}", F.when(open_[c], F.col(f"above_{c}") + 1), F.lit(0)).cast("bigint")
    full = kept.join(counted, ["query_id", "doc_id"], "left").select("query_id", "doc_id", *[rank(c).alias(f"{c}_rank") for c in weights])
    score = sum((F.when(F.col(f"{c}_rank") > 0, share(c, F.col(f"{c}_rank"))).otherwise(0.0) for c in weights), F.lit(0.0))
    return top_k(full.select("query_id", "doc_id", score.alias("score"), *[f"{c}_rank" for c in weights]), k)


def above(blocks: Blocks, asked: DataFrame, sides: tuple[str, ...] = SIDES) -> DataFrame:
    """(query_id, doc_id, above_tfidf, above_bm25) for (query_id, doc_id, tfidf, bm25): documents above each in whole rankings."""
    return summarize(blocks, Above(sides), asked.select("query_id", "doc_id", *sides)).groupBy("query_id", "doc_id").agg(*[F.sum(f"above_{c}").alias(f"above_{c}") for c in SIDES])


def ends(blocks: Blocks) -> DataFrame:
    """(query_id, lo_tfidf, hi_tfidf, lo_bm25, hi_bm25) of all positive scores, stored; null where a side has none."""
    low = lambda c: F.min(F.nanvl(c, F.lit(None).cast("double"))).alias(c)
    high = lambda c: F.max(F.nanvl(c, F.lit(None).cast("double"))).alias(c)
    return cut_lineage(summarize(blocks, Ends()).groupBy("query_id").agg(low("lo_tfidf"), high("hi_tfidf"), low("lo_bm25"), high("hi_bm25")))


def fused_by_score(blocks: Blocks, weights: dict[str, float], k: int) -> DataFrame:
    """:func:`retrieval.weighted_fusion` of both whole rankings: (query_id, doc_id, score, rank)."""
    return top_k(summarize(blocks, Fused(weights, k), ends(blocks)), k)


def leaders(blocks: Blocks, k: int) -> DataFrame:
    """(query_id, doc_id, b, t): scaled BM25 and TF-IDF of the documents that some weight can bring among the k best."""
    return may_lead(cut_lineage(summarize(blocks, Leaders(k), ends(blocks))), k, "b", "t")


def best_sections(blocks: Blocks, weights: tuple[float, ...], k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) over the weighted sections of each document, packed ``together``."""
    return top_k(summarize(blocks, Sections(weights, k)), k)


def label_ranks(blocks: Blocks, asked: DataFrame, side: str) -> DataFrame:
    """(query_id, doc_id, rank) in the whole ranking of ``side`` for (query_id, labels), see :class:`LabelRanks`; ``blocks`` have labels."""
    return summarize(blocks, LabelRanks(side), asked.select("query_id", "labels"))


def stated_ranks(blocks: Blocks, pairs: DataFrame, side: str) -> DataFrame:
    """(query_id, doc_id, rank) in the whole ranking of ``side`` for the stated pairs that it has."""
    found = cut_lineage(summarize(blocks, Stated(), pairs.select("query_id", "doc_id")).where(F.col(side) > 0))
    return above(blocks, found, (side,)).select("query_id", "doc_id", (F.col(f"above_{side}") + 1).alias("rank"))
