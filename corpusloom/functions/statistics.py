"""Statistics as column expressions and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mcnemar_p(n01: Column, n10: Column) -> Column:
    """Exact two-sided McNemar test: twice the lower binomial tail at one half, at most 1.

    The tail's terms are summed by their logarithms, each from the one before.
    """
    n, low = (n01 + n10).cast("double"), F.least(n01, n10)
    start = F.struct((-n * math.log(2)).alias("term"), F.exp(-n * math.log(2)).alias("sum"))

    def step(state: Column, i: Column) -> Column:
        term = state.term + F.log((n - i + 1) / i)
        return F.struct(term.alias("term"), (state.sum + F.exp(term)).alias("sum"))

    steps = F.when(low > 0, F.sequence(F.lit(1).cast("long"), low.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step, lambda s: s.sum)))


def wilson(k: Column, n: Column, z: float = 1.96) -> Column:
    """struct(low, high): Wilson's interval of a share; both 0 without trials."""
    p, d = k / n, 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    empty = n == 0
    return F.struct(F.when(empty, 0.0).otherwise((centre - half) / d).alias("low"), F.when(empty, 0.0).otherwise((centre + half) / d).alias("high"))


def holm(tests: DataFrame, p: str = "p", order: tuple[str, ...] = (), out: str = "p_holm") -> DataFrame:
    """``tests`` with Holm-Bonferroni adjusted p-values; one family, so a table of tests, not of data.

    Ties of p take the order of ``order``; they get the same value either way.
    """
    by = Window.orderBy(F.col(p), *order)
    steps = (F.count("*").over(Window.partitionBy()) - F.row_number().over(by) + 1) * F.col(p)
    return tests.withColumn("_step", steps).withColumn(out, F.least(F.lit(1.0), F.max("_step").over(by.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def kappa(pairs: DataFrame, a: str, b: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Cohen's kappa of two label columns: ``n, agreed, kappa``, for each group of ``by``.

    One label used throughout gives 1 if the two agree everywhere and else 0; no pairs, null.
    """
    keys = list(by)
    table = pairs.groupBy(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("c"))
    total = table.groupBy(*keys).agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("_a") == F.col("_b"), F.col("c"))), F.lit(0)).alias("agreed"))
    marginal = table.select(*keys, F.col("_a").alias("label"), F.col("c").alias("ca"), F.lit(0).cast("long").alias("cb")).unionByName(table.select(*keys, F.col("_b").alias("label"), F.lit(0).cast("long").alias("ca"), F.col("c").alias("cb")))
    expected = marginal.groupBy(*keys, "label").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb")).groupBy(*keys).agg(F.sum(F.col("ca") * F.col("cb")).alias("product"))
    both = total.join(expected, keys) if keys else total.crossJoin(expected)  # one row each
    po, pe = F.col("agreed") / F.col("n"), F.col("product") / (F.col("n") * F.col("n"))
    value = F.when(F.col("n") == 0, None).when(F.col("product") == F.col("n") * F.col("n"), F.when(F.col("agreed") == F.col("n"), 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return both.select(*keys, "n", "agreed", value.alias("kappa"))


def interpret(kappa: Column) -> Column:
    return F.when(kappa.isNull(), "n/a").when(kappa >= 0.8, "almost perfect").when(kappa >= 0.6, "substantial").when(kappa >= 0.4, "moderate").when(kappa >= 0.2, "fair").otherwise("slight - guideline needs work")


def label_scores(predictions: DataFrame, gold: str, pred: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Macro-F1, accuracy and the majority-class floor for each group of ``by``.

    The macro average runs over the labels that the group has as gold or predicted.
    """
    keys = list(by)
    table = predictions.groupBy(*keys, F.col(gold).alias("_g"), F.col(pred).alias("_p")).agg(F.count("*").alias("c"))
    hit = F.when(F.col("_g") == F.col("_p"), F.col("c")).otherwise(0)
    long = table.select(*keys, F.col("_g").alias("label"), F.col("c").alias("is_gold"), F.lit(0).cast("long").alias("is_pred"), hit.alias("hit")).unionByName(
        table.select(*keys, F.col("_p").alias("label"), F.lit(0).cast("long").alias("is_gold"), F.col("c").alias("is_pred"), F.lit(0).cast("long").alias("hit"))
    )
    each = long.groupBy(*keys, "label").agg(F.sum("is_gold").alias("g"), F.sum("is_pred").alias("p"), F.sum("hit").alias("h"))
    f1 = F.when(F.col("h") == 0, 0.0).otherwise(2 * F.col("h") / (F.col("g") + F.col("p")))
    return each.groupBy(*keys).agg(F.sum("g").alias("n"), F.avg(f1).alias("macro_f1"), (F.sum("h") / F.sum("g")).alias("accuracy"), (F.max("g") / F.sum("g")).alias("floor"), F.max_by("label", F.struct("g", "label")).alias("majority"))
