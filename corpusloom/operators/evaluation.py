"""Agreement, distributions and model comparison with significance tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.statistics import holm, interpret, kappa, label_scores, mcnemar_p
from corpusloom.functions.text import cell

BUCKETS = ("mono", "low", "med", "high")
LABELS = ("pos", "neg", "neu")
MIXED = ("low", "med", "high")
LEAST_SCOPE = 20
THIN_BUCKET = 100


def last_rows(sheet: DataFrame, order: str = "line") -> DataFrame:
    """One row for each non-blank id, the last."""
    kept = sheet.where(F.trim(F.coalesce("comment_id", F.lit(""))) != "").withColumn("comment_id", F.trim("comment_id"))
    others = [c for c in kept.columns if c not in ("comment_id", order)]
    return kept.groupBy("comment_id").agg(F.max(F.struct(order, *others)).alias("_r")).select("comment_id", *(F.col(f"_r.{c}").alias(c) for c in others))


def label_pairs(a: DataFrame, b: DataFrame, axis: str) -> DataFrame:
    """``comment_id, va, vb``: two annotators' labels where both gave one; a skip by either leaves the other axes."""
    left = a.select("comment_id", cell(F.col(axis)).alias("va"))
    pairs = left.join(b.select("comment_id", cell(F.col(axis)).alias("vb")), "comment_id").where("va <> '' and vb <> ''")
    return pairs if axis == "sentiment" else pairs.where("va <> 'skip' and vb <> 'skip'")


def agreement(pairs: DataFrame, target: float) -> DataFrame:
    """``n, agreed, kappa, wording, meets_target`` of pairs."""
    return kappa(pairs, "va", "vb").withColumns({"wording": interpret(F.col("kappa")), "meets_target": F.col("kappa") >= target})


def confusions(pairs: DataFrame, top: int = 5) -> DataFrame:
    """The most common unordered disagreements; ties by label."""
    wrong = pairs.where("va <> vb").groupBy(F.least("va", "vb").alias("x"), F.greatest("va", "vb").alias("y")).agg(F.count("*").alias("n"))
    return wrong.orderBy(F.desc("n"), "x", "y").limit(top)


def disagreements(pairs: DataFrame, sheet: DataFrame, n: int = 40) -> DataFrame:
    """The first ``n`` disagreements by id, with the start of the text."""
    wrong = pairs.where("va <> vb").join(sheet.select("comment_id", F.left("text", F.lit(70)).alias("text")), "comment_id", "left")
    return wrong.orderBy("comment_id").limit(n)


def distribution(rows: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """``value, n, share`` for each value, in every case."""
    got = rows.agg(F.count("*").alias("_all"), *(F.count_if(F.col(column) == v).alias(v) for v in values))
    listed = F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).alias("n")) for v in values))
    return got.select("_all", F.explode(listed).alias("r")).select("r.value", "r.n", F.coalesce(F.try_divide("r.n", "_all"), F.lit(0.0)).alias("share"))


def skip_rate(labelled: DataFrame) -> DataFrame:
    """``n, skipped, skip_rate, pull_ratio``: how many rows have to be pulled for one label."""
    skipped = F.count_if(F.col("sentiment") == "skip")
    return labelled.agg(F.count("*").alias("n"), skipped.alias("skipped"), F.try_divide(skipped, F.count("*")).alias("skip_rate"), (F.count("*") / F.greatest(F.lit(1), F.count("*") - skipped)).alias("pull_ratio"))


def labels_within(rows: DataFrame, group: str, label: str, values: tuple[str, ...] = LABELS, degenerate: float = 0.8) -> DataFrame:
    """Label counts in each group, the majority's share, and whether it leaves nothing to test."""
    got = rows.groupBy(group).agg(F.count("*").alias("n"), *(F.count_if(F.col(label) == v).alias(v) for v in values))
    return got.withColumn("majority", F.greatest(*values) / F.col("n")).withColumn("degenerate", F.col("majority") >= degenerate)


def detector_scores(pairs: DataFrame, predicted: str, truth: str, mixed: tuple[str, ...] = MIXED) -> DataFrame:
    """Exact agreement, and precision and recall of mixed against not mixed; 0 where nothing could be found."""
    p, t = F.col(predicted).isin(*mixed), F.col(truth).isin(*mixed)
    got = pairs.agg(F.count("*").alias("n"), F.count_if(F.col(predicted) == F.col(truth)).alias("agreed"), F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"))
    return got.withColumns({"precision": F.coalesce(F.try_divide("tp", F.expr("tp + fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", F.expr("tp + fn")), F.lit(0.0))})


def grid(pairs: DataFrame, row: str, column: str, values: tuple[str, ...]) -> DataFrame:
    """Counts of each value of ``column`` for each value of ``row``."""
    return pairs.groupBy(row).agg(*(F.count_if(F.col(column) == v).alias(v) for v in values))


# --- comparison of representations ------------------------------------------------------------------


def one_classifier(predictions: DataFrame, classifier: str | None = None) -> DataFrame:
    """One prediction for each comment and representation: of ``classifier``, or else of the last by name."""
    if classifier is not None:
        return predictions.where(F.col("classifier") == classifier)
    others = [c for c in predictions.columns if c not in ("comment_id", "representation", "classifier")]
    best = predictions.groupBy("comment_id", "representation").agg(F.max(F.struct("classifier", *others)).alias("_r"))
    return best.select("comment_id", "representation", "_r.*")


def aligned(predictions: DataFrame) -> DataFrame:
    """Predictions of the comments that every representation has."""
    n_all = predictions.agg(F.count_distinct("representation").alias("_all"))
    common = predictions.groupBy("comment_id").agg(F.count_distinct("representation").alias("_n")).crossJoin(F.broadcast(n_all)).where("_n = _all")  # one row
    return predictions.join(common.select("comment_id"), "comment_id", "left_semi")


def overall(predictions: DataFrame) -> DataFrame:
    """``representation, n, macro_f1, accuracy, floor, majority, above_floor``."""
    return label_scores(predictions, "gold", "pred", ("representation",)).withColumn("above_floor", F.col("accuracy") - F.col("floor"))


def by_bucket(predictions: DataFrame) -> DataFrame:
    """The same within each density bucket, with ``thin`` for buckets of under 100 comments."""
    return label_scores(predictions, "gold", "pred", ("density", "representation")).withColumn("thin", F.col("n") < THIN_BUCKET)


def best_representation(scores: DataFrame) -> DataFrame:
    """``best, macro_f1``: the highest macro-F1 overall; the first by name of equals."""
    return scores.orderBy(F.desc("macro_f1"), "representation").limit(1).select(F.col("representation").alias("best"), "macro_f1")


def margins(bucket_scores: DataFrame, best: DataFrame) -> DataFrame:
    """``density, n, best, best_f1, rest_f1, margin``: the best representation against the best of the others."""
    joined = bucket_scores.crossJoin(F.broadcast(best.select("best")))  # one row
    own = F.col("representation") == F.col("best")
    got = joined.groupBy("density", "best").agg(F.max("n").alias("n"), F.max(F.when(own, F.col("macro_f1"))).alias("best_f1"), F.coalesce(F.max(F.when(~own, F.col("macro_f1"))), F.lit(0.0)).alias("rest_f1"))
    return got.withColumn("margin", F.col("best_f1") - F.col("rest_f1"))


def significance(predictions: DataFrame, least: int = LEAST_SCOPE) -> DataFrame:
    """McNemar's exact test for each pair of representations, over all comments and within buckets, Holm-adjusted jointly.

    ``n01`` counts comments that the first has wrong and the second right.  Scopes under ``least`` comments are left out.
    """
    right = predictions.select("comment_id", "density", "representation", (F.col("pred") == F.col("gold")).alias("ok"))
    a = right.select("comment_id", "density", F.col("representation").alias("a"), F.col("ok").alias("ok_a"))
    b = right.select("comment_id", F.col("representation").alias("b"), F.col("ok").alias("ok_b"))
    pairs = a.join(b, "comment_id").where("a < b")
    counted = pairs.groupBy("a", "b", "density").agg(F.count("*").alias("n"), F.count_if(~F.col("ok_a") & F.col("ok_b")).alias("n01"), F.count_if(F.col("ok_a") & ~F.col("ok_b")).alias("n10"))
    scoped = counted.select("a", "b", F.col("density").alias("scope"), "n", "n01", "n10").where(F.col("scope").isin(*BUCKETS)).unionByName(counted.groupBy("a", "b").agg(F.lit("all").alias("scope"), F.sum("n").alias("n"), F.sum("n01").alias("n01"), F.sum("n10").alias("n10")))
    tests = scoped.where(F.col("n") >= least).withColumn("p", mcnemar_p(F.col("n01"), F.col("n10")))
    return holm(tests, order=("a", "b", "scope")).withColumn("significant", F.col("p_holm") < 0.05)


def length_control(predictions: DataFrame) -> DataFrame:
    """``density, n, median_tokens, mean_tokens`` of the comments."""
    rows = predictions.groupBy("comment_id", "density").agg(F.first("n_tokens").alias("n_tokens"))
    return rows.groupBy("density").agg(F.count("*").alias("n"), F.percentile("n_tokens", F.lit(0.5)).alias("median_tokens"), F.avg("n_tokens").alias("mean_tokens"))


def confusion_matrix(predictions: DataFrame, labels: tuple[str, ...] = LABELS) -> DataFrame:
    """Gold by predicted, in the order of ``labels``, empty rows included."""
    got = predictions.agg(*(F.count_if((F.col("gold") == g) & (F.col("pred") == p)).alias(f"{g}|{p}") for g in labels for p in labels))
    listed = F.array(*(F.struct(F.lit(g).alias("gold"), *(F.col(f"{g}|{p}").alias(p) for p in labels)) for g in labels))
    return got.select(F.explode(listed).alias("r")).select("r.*")


def best_of_rest(scores: DataFrame, group: str = "density") -> DataFrame:
    """Each representation's score beside the best of the others in its group."""
    by = Window.partitionBy(group).orderBy(F.desc("macro_f1"), "representation")
    first, second = F.max(F.when(F.col("_k") == 1, F.col("macro_f1"))), F.max(F.when(F.col("_k") == 2, F.col("macro_f1")))
    numbered = scores.withColumn("_k", F.row_number().over(by))
    tops = Window.partitionBy(group)
    return numbered.withColumn("rest_f1", F.when(F.col("_k") == 1, second.over(tops)).otherwise(first.over(tops))).drop("_k")
