"""Classification queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpuslane.operators import evaluation as E
from corpuslane.operators import learning as L
from corpuslane.operators import records as R
from corpuslane.runtime import cut_lineage, table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("lang is not null and text is not null")
    return d.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")).dropDuplicates(["id"])


@query()
def ml_language_classifier(spark, sf_dir):
    return E.class_metrics(L.classify_texts(_texts(spark, sf_dir)).where("split = 'test'"))


@query()
def ml_language_svm(spark, sf_dir):
    return E.class_metrics(L.classify_texts(_texts(spark, sf_dir), "svm").where("split = 'test'"))


CENT = """c AS (SELECT label, list(m ORDER BY i) AS pvec FROM (SELECT label, i, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS v FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT vec_id AS doc_id, e.label AS actual, c.label, round(greatest(list_sum(list_transform(list_zip(embedding, pvec), lambda z: CAST(z[1] AS DOUBLE) * z[2])), 0), 6) AS score FROM embeddings e CROSS JOIN c),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) = 1)"""


@query(f"WITH {CENT} SELECT doc_id, label, score FROM b")
def rte_prototype_labels(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")
    return L.prototype_labels(v.drop("label"), L.centroids(v))


@query(f"WITH {CENT}, p AS (SELECT actual, label AS predicted FROM b), l AS (SELECT DISTINCT unnest([actual, predicted]) AS label FROM p), m AS (SELECT l.label, count_if(actual = l.label) AS support, count_if(predicted = l.label) AS guessed, count_if(actual = l.label AND predicted = l.label) AS hit FROM p CROSS JOIN l GROUP BY 1), r AS (SELECT *, CASE WHEN guessed = 0 THEN 0 ELSE hit / guessed END AS p, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS r FROM m) SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM r")
def evl_class_metrics(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"), "label")
    guessed = cut_lineage(L.prototype_labels(v.drop("label"), L.centroids(v)).withColumnRenamed("label", "predicted"))
    return E.class_metrics(guessed.join(v.select("doc_id", F.col("label").alias("actual")), "doc_id").select("actual", "predicted"))
