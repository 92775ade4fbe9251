"""Linear classifiers over sparse or dense representations, and cross-validation with per-row predictions."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` with ``weight``: n / (number of classes * size of the row's class)."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_c"))
    whole = sizes.agg(F.sum("_c").alias("_n"), F.count("*").alias("_k"))
    factors = sizes.crossJoin(F.broadcast(whole)).select(F.col(label), (F.col("_n") / (F.col("_k") * F.col("_c"))).alias("weight"))  # a row for each class
    return rows.join(F.broadcast(factors), label)


def fold_vectors(bags: DataFrame, idf: np.ndarray) -> DataFrame:
    """``bags`` (at, tf) with ``features``: one sparse unit vector for each text over the terms that have an idf; zeros without any.

    Term numbers come from the vocabulary's order; its size is bounded by the representation's ``max_features``.
    """
    known = ~np.isnan(idf)
    size, place = int(known.sum()), np.cumsum(known) - 1

    @F.udf(VectorUDT())
    def vector(at, tf):  # a vector type has no built-in constructor from sparse pairs
        at, tf = np.array(at, int), np.array(tf, float)
        own = known[at]
        w = (1 + np.log(tf[own])) * idf[at[own]]
        return SparseVector(size, place[at[own]], w / np.sqrt(w @ w) if len(w) else w)

    return bags.withColumn("features", vector("at", "tf")).drop("at", "tf")


def dense_rows(vectors: DataFrame, key: str, column: str = "vector") -> DataFrame:
    return vectors.select(key, array_to_vector(F.col(column).cast("array<double>")).alias("features"))


def classifier(name: str, n_rows: int, seed: int = 2026):
    """``logreg``: multinomial with L2 of 1 / n, which is C = 1 under balanced weights.  ``svm``: one-vs-rest hinge loss, close
    to but not equal to a squared-hinge machine."""
    if name == "logreg":
        return LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", regParam=1.0 / n_rows, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-4, family="multinomial")
    if name == "svm":
        return OneVsRest(classifier=LinearSVC(regParam=1.0 / n_rows, standardization=False, maxIter=100, tol=1e-4), featuresCol="features", labelCol="label", weightCol="weight")
    raise ValueError(f"no classifier {name}")


CLASSIFIERS = ("logreg", "svm")
ROWS_PER_TASK = 5000
#: Rows that folds fitted beside each other hold in all; one fold at least.
ROWS_AT_ONCE = 200_000


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and without its lineage, in the session's checkpoint folder; cached where none is set (tests)."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.cache()


def fit_predict(train: DataFrame, test: DataFrame, clf: str, target: str = "gold") -> DataFrame:
    """The test rows with ``pred`` in place of ``features``, by a model of the training rows (features, target).

    Each step of a fit is a job, so the training rows should have no long lineage.
    """
    sizes = {r[0]: r[1] for r in train.groupBy(target).count().collect()}  # a row for each class
    labels, n = sorted(sizes), sum(sizes.values())
    choose = lambda of: reduce(lambda c, x: c.when(F.col(target) == x, of(x)), labels[1:], F.when(F.col(target) == labels[0], of(labels[0])))
    rows = train.select("features", choose(lambda x: float(labels.index(x))).alias("label"), choose(lambda x: n / (len(labels) * sizes[x])).alias("weight")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        rows.count()
        model = classifier(clf, n).fit(rows.coalesce(max(1, n // ROWS_PER_TASK)))  # each step of a fit is a job over these
    finally:
        rows.unpersist()
    name = F.array(*(F.lit(x) for x in labels))
    return model.transform(test).withColumn("pred", F.element_at(name, F.col("prediction").cast("int") + 1)).select(*(c for c in test.columns if c != "features"), "pred")


def cross_validate(rows: DataFrame, representation: str, make, clf: str = "logreg", k: int = 5, key: str = "comment_id") -> DataFrame:
    """Predictions of all folds: comment_id, gold, density, n_tokens, representation, classifier, fold (from 1), pred.

    ``rows`` has key, text, gold, density, n_tokens and fold (0 to k - 1; null rows are in no fold).  ``make`` gives a fresh
    ``Tfidf``, fitted on each fold's training rows, or is a table (key, vector) fitted without labels; rows that it has no
    vector for get no prediction.  Folds without rows on either side give none, and a fold beyond ``k`` is an error.
    Texts are read once for all folds, and folds are fitted beside each other as far as ``ROWS_AT_ONCE`` goes.
    """
    present = {r.fold: r["count"] for r in rows.where("fold is not null").groupBy("fold").count().collect()}  # k rows
    if max(present, default=0) >= k:
        raise ValueError(f"rows have a fold {max(present)}, of {k} from 0")
    rows = rows.where("fold is not null").select(F.col(key).alias("comment_id"), "text", "gold", "density", "n_tokens", "fold")
    if len(present) > 1 and isinstance(make, DataFrame):
        dense = dense_rows(make, key)
        whole = settled(rows.drop("text").join(dense.select(F.col(key).alias("comment_id"), "features"), "comment_id"))
        present = {r.fold: r["count"] for r in whole.groupBy("fold").count().collect()}
        of = lambda fold: whole
    elif len(present) > 1:
        bags, idf = make().fit_folds(rows, k)
        of = lambda fold: fold_vectors(bags, idf[:, fold])

    if len(present) < 2:
        raise ValueError("no fold has rows on both sides")

    def run(fold: int) -> DataFrame:
        x = of(fold)
        out = fit_predict(x.where(F.col("fold") != fold), x.where(F.col("fold") == fold), clf)
        # Each fold is settled, so no plan holds more than one of them.
        return settled(out.select("comment_id", "gold", "density", "n_tokens", F.lit(representation).alias("representation"), F.lit(clf).alias("classifier"), F.lit(fold + 1).alias("fold"), "pred"))

    with ThreadPool(max(1, min(k, ROWS_AT_ONCE // sum(present.values())))) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(rows.sparkSession)(run), sorted(present)))


def cross_validate_all(rows: DataFrame, representations: dict, classifiers: tuple[str, ...] = ("logreg",), k: int = 5, key: str = "comment_id") -> tuple[DataFrame, list[str]]:
    """Predictions of every representation and classifier, and the names of those that can't be had here (given as None)."""
    runs = [cross_validate(rows, name, make, clf, k, key) for name, make in representations.items() if make is not None for clf in classifiers]
    return reduce(DataFrame.unionByName, runs), [name for name, make in representations.items() if make is None]
