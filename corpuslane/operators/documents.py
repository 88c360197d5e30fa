"""Document structure, light enrichment, citation checks, routing and training rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslane.functions import scalars as S
from corpuslane.functions import text as X

ENTITY_KINDS = ("methods", "datasets", "tasks", "metrics", "institutions")
# Words that show that results are measured.
METRIC_WORDS = r"\b(?:accuracy|precision|recall|f1(?:-score)?|bleu|rouge(?:-[12l])?|perplexity|mrr|map|ndcg(?:@\d+)?|auc|exact match|treesim|episode return|sample efficiency|wall-clock time)\b"


def current(parsed: DataFrame) -> DataFrame:
    """One row a parsed paper: the last parsed."""
    best = parsed.where("parsed_id is not null").withColumn("_m", F.map_entries("sections")).drop("sections")
    rows = best.groupBy("parsed_id").agg(F.max_by(F.struct(*[c for c in best.columns if c != "parsed_id"]), F.coalesce("parsed_at", F.lit("0001-01-01").cast("timestamp_ntz"))).alias("_r"))
    return rows.select("parsed_id", "_r.*").withColumn("sections", F.map_from_entries("_m")).drop("_m")


def section_rows(parsed: DataFrame) -> DataFrame:
    """(parsed_id, part, text) of the sections that hold something."""
    return parsed.select("parsed_id", F.explode("sections").alias("part", "text")).where(F.trim(F.coalesce("text", F.lit(""))) != "")


# Order of sections in a paper; others follow by name.
SECTION_ORDER = ("abstract", "introduction", "related_work", "method", "results", "discussion", "limitations", "conclusion")


def section_texts(parsed: DataFrame) -> DataFrame:
    """(doc_id, text): the texts of all sections of a paper in order, as an array."""
    known = F.array(*[F.lit(p) for p in SECTION_ORDER])
    others = F.transform(F.array_sort(F.filter(F.map_entries("sections"), lambda e: ~F.array_contains(known, e["key"]))), lambda e: e["value"])
    texts = F.concat(F.transform(known, lambda p: F.try_element_at("sections", p)), others)
    return parsed.select(F.col("parsed_id").alias("doc_id"), F.filter(texts, lambda t: F.trim(F.coalesce(t, F.lit(""))) != "").alias("text"))


def structural_checks(parsed: DataFrame) -> DataFrame:
    """(parsed_id, finding): what the structure of a paper lacks."""
    size = lambda part: F.length(F.coalesce(F.col("sections")[part], F.lit("")))
    found = F.array(
        F.when(size("abstract") < 200, "short abstract"), F.when(size("method") < 400, "short method"), F.when(size("results") < 300, "short results"), F.when(size("conclusion") < 150, "short conclusion"),
        F.when(F.coalesce(F.size("reference_entries"), F.lit(0)) < 10, "few references"), F.when(~F.lower(F.array_join(F.map_values("sections"), "\n")).rlike(METRIC_WORDS), "no metric"),
        F.when(size("limitations") == 0, "no limitations"), F.when(size("related_work") == 0, "no related work"),
    )
    return parsed.select("parsed_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("finding"))


def entity_rows(parsed: DataFrame) -> DataFrame:
    """(parsed_id, kind, entity)."""
    lists = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"entities.{k}").alias("es")) for k in ENTITY_KINDS])
    return parsed.select("parsed_id", F.explode(lists).alias("l")).select("parsed_id", "l.kind", F.explode("l.es").alias("entity")).where("entity is not null")


def reference_counts(parsed: DataFrame) -> DataFrame:
    """(parsed_id, references_kept, repeated): entries of at least 20 characters with a letter, by their normal key."""
    r = parsed.select("parsed_id", F.explode("reference_entries").alias("entry")).where((F.length("entry") >= 20) & F.col("entry").rlike(r"\p{L}"))
    keys = r.groupBy("parsed_id", X.normal_key(F.col("entry")).alias("k")).agg(F.count("*").alias("c"))
    return keys.groupBy("parsed_id").agg(F.count("*").alias("references_kept"), (F.sum("c") - F.count("*")).alias("repeated"))


def extractive_summary(docs: DataFrame, n: int, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(doc_id, place, sentence): the n sentences of each document that PageRank over TF-IDF cosine puts first.

    ``text`` is one text or an array of them; no sentence spans two. idf is ln((1 + n) / (1 + df)) + 1 over the n
    sentences of the document. The sentence graph belongs to one document, so the ranking runs document by document inside the tasks.
    """
    sentences = F.flatten(F.transform("text", X.sentences)) if dict(docs.dtypes)["text"].startswith("array") else X.sentences(F.col("text"))
    split = docs.where("doc_id is not null").select("doc_id", sentences.alias("s")).where(F.size("s") > 0).select("doc_id", "s", F.transform("s", X.content_tokens).alias("w"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc, sents, words in zip(frame["doc_id"], frame["s"], frame["w"]):
                vocab = {t: i for i, t in enumerate(sorted({t for ws in words for t in ws}))}
                m = np.zeros((len(sents), max(1, len(vocab))))
                for i, ws in enumerate(words):
                    for t in ws:
                        m[i, vocab[t]] += 1
                m *= np.log((1 + len(sents)) / (1 + (m > 0).sum(axis=0))) + 1
                norm = np.linalg.norm(m, axis=1, keepdims=True)
                m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
                rank = np.full(len(sents), 1 / len(sents))
                degree = m @ m.sum(axis=0) - (m * m).sum(axis=1)
                for _ in range(rounds):
                    flow = np.divide(rank, degree, out=np.zeros_like(rank), where=degree > 1e-12)
                    spread = m @ (m.T @ flow) - (m * m).sum(axis=1) * flow
                    rank = (1 - damping) / len(sents) + damping * (spread + rank[degree <= 1e-12].sum() / len(sents))
                best = sorted(np.lexsort((np.arange(len(sents)), -np.round(rank, 9)))[:n])
                out += [(doc, int(i), sents[i]) for i in best]
            yield pd.DataFrame(out, columns=["doc_id", "place", "sentence"])

    return split.mapInPandas(run, "doc_id bigint, place int, sentence string")


def check_citations(generations: DataFrame, available: list[str]) -> DataFrame:
    """(generation_id, used, unsupported, passed): cited ids against those that may be cited."""
    allowed = F.array(*[F.lit(a) for a in available])
    g = generations.where("text is not null").withColumn("_u", X.output_source_ids(F.col("text")))
    used, bad = F.size("_u").cast("bigint"), F.size(F.array_except("_u", allowed)).cast("bigint")
    return g.select("generation_id", used.alias("used"), bad.alias("unsupported"), ((used > 0) & (bad == 0)).alias("passed"))


def faithfulness(generations: DataFrame, prompts: DataFrame, available: list[str]) -> DataFrame:
    """(task, outputs, clean, pct_clean) over checked generations."""
    checked = check_citations(generations, available).join(generations.select("generation_id", "prompt_id").distinct(), "generation_id").join(prompts, "prompt_id")
    return checked.groupBy("task").agg(F.count("*").alias("outputs"), F.count_if(F.col("unsupported") == 0).alias("clean")).withColumn("pct_clean", F.round(100.0 * F.col("clean") / F.col("outputs"), 4))


def coverage_bands(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, eligible, nearby, rejected): documents that share terms with a query, by the share of its terms."""
    terms = queries.select("query_id", X.citation_terms(F.col("text")).alias("t")).where(F.size("t") > 0)
    wanted = terms.select("query_id", F.size("t").alias("n"), F.explode("t").alias("term"))
    held = docs.select("doc_id", F.explode(F.array_distinct(X.content_tokens(F.col("text")))).alias("term"))
    share = wanted.join(held, "term").groupBy("query_id", "doc_id").agg((F.count("*") / F.max("n")).alias("share"))
    band = S.coverage_band(F.col("share"))
    return share.groupBy("query_id").agg(*[F.count_if(band == b).alias(b) for b in ("eligible", "nearby", "rejected")])


def route(prompts: DataFrame) -> DataFrame:
    """(prompt_id, route, topic)."""
    t = F.col("prompt_text")
    way = F.when(t.rlike(r"(?i)recommend|citations? for|empfiehl|recommande|recomienda"), "recommendation").when(t.rlike(r"(?i)uploaded|hochgeladen|déposé|subido|peer review|Gutachten"), "direct").otherwise("retrieval")
    topic = F.nullif(F.regexp_extract(t, r"(?i)(?:paragraph about|paper on|work on|say about) (.+?)[.?!]*$", 1), F.lit(""))
    return prompts.select("prompt_id", way.alias("route"), F.coalesce(topic, F.lit("-")).alias("topic"))


def output_form(text: Column) -> Column:
    """none, json, broken json, markdown, list or prose."""
    body = F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s*```\w*\s*", ""), r"```\s*$", ""))
    as_json = F.when(F.try_parse_json(body).isNotNull(), "json").otherwise("broken json")
    return F.when(text.isNull(), "none").when(text.rlike(r"^\s*(```\w*\s*)?[{\[]"), as_json).when(text.rlike(r"(?m)^#{1,6} "), "markdown").when(text.rlike(r"(?m)^\s*([-*•]|\d+[.)])\s"), "list").otherwise("prose")


def chat_rows(generations: DataFrame, prompts: DataFrame, system: str = "You answer questions about research papers.") -> DataFrame:
    """(generation_id, task, style, messages): system, user and assistant turns of the generations that say something."""
    g = generations.select("generation_id", "prompt_id", "text").where(F.trim(F.coalesce("text", F.lit(""))) != "").distinct()
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return g.join(prompts.distinct(), "prompt_id").select("generation_id", "task", "style", F.array(turn("system", F.lit(system)), turn("user", F.col("prompt_text")), turn("assistant", F.col("text"))).alias("messages"))
