"""Classification of texts and prototype classification of vectors."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import HashingTF, IDF, StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuslane.functions import text as X
from corpuslane.operators import records as R

#: Models are fitted on at most so many labelled rows, drawn by seeded hash; every row is classified.
FIT_ROWS = 20_000
FEATURES = 1 << 14


def classify_texts(rows: DataFrame, kind: str = "logistic", seed: str = "42") -> DataFrame:
    """(id, actual, predicted, split) of (id, text, label): a linear model on TF-IDF of words and pairs, weights balanced by class.

    The split is 80 to 20 in each class by seeded hash.
    """
    data = R.split_by_hash(rows.where("label is not null and text is not null"), "id", seed, (("train", 80), ("test", 20))).withColumn("words", X.analyze(F.col("text")))
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=FEATURES).transform(data)
    fit = tf.where("split = 'train'").orderBy(R.hash_order(seed, "id")).limit(FIT_ROWS)
    indexer = StringIndexer(inputCol="label", outputCol="y", stringOrderType="frequencyDesc").fit(fit)
    idf = IDF(inputCol="tf", outputCol="features", minDocFreq=2).fit(fit)
    labelled = indexer.setHandleInvalid("keep").transform(idf.transform(fit))
    classes = len(indexer.labels)
    counts = labelled.groupBy("y").agg(F.count("*").alias("c"))
    total = labelled.count()
    weighted = labelled.join(F.broadcast(counts), "y").withColumn("w", F.lit(float(total)) / (classes * F.col("c")))  # a row a class
    if kind == "logistic":
        model = LogisticRegression(labelCol="y", weightCol="w", maxIter=60, regParam=0.01).fit(weighted)
    else:
        model = OneVsRest(classifier=LinearSVC(maxIter=12, regParam=0.01), labelCol="y", weightCol="w", parallelism=4).fit(weighted)
    names = F.array(*[F.lit(x) for x in indexer.labels])
    scored = model.transform(idf.transform(tf))
    return scored.select("id", F.col("label").alias("actual"), F.get(names, F.col("prediction").cast("int")).alias("predicted"), "split")


def prototype_labels(vectors: DataFrame, prototypes: DataFrame) -> DataFrame:
    """(doc_id, label, score): the label of the prototype (label, pvec) with the largest dot product, floored at 0.

    Prototypes are few, given and small: one row a label.
    """
    dot = F.aggregate(F.zip_with("vec", "pvec", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    scored = vectors.crossJoin(F.broadcast(prototypes)).select("doc_id", "label", F.round(F.greatest(dot, F.lit(0.0)), 6).alias("score"))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("label"))).alias("b"))
    return best.select("doc_id", "b.label", "b.score")


def centroids(vectors: DataFrame) -> DataFrame:
    """(label, pvec): the mean vector of each label."""
    long = vectors.select("label", F.posexplode("vec").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("pvec"))
