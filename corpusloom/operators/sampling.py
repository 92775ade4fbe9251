"""Stratified samples with recorded inclusion probabilities.

Random order is the order of ``md5(seed|id)``: the same on every engine and after every retry.  Samples are
small, so global numbering runs on them only, never on the pool.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .density import DensityModel, measure

SEED = 2026
DENSITY_ORDER = ("high", "med", "low", "mono")
SCREEN_ORDER = ("high", "med", "low", "unknown", "mono")


def shuffled(key: str, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def natural_probe(pool: DataFrame, n: int, seed: int = SEED, key: str = "comment_id") -> DataFrame:
    """``n`` rows, uniformly without replacement."""
    return pool.orderBy(shuffled(key, seed), key).limit(n)


def allocate(available: dict[str, int], budget: int, strata: tuple[str, ...] = DENSITY_ORDER, take_all: tuple[str, ...] = ()) -> dict[str, int]:
    """How many to take of each stratum: ``take_all`` in full first, then equal shares with spillover to later ones."""
    taken = {}
    for s in (s for s in strata if s in take_all):
        taken[s] = min(available.get(s, 0), budget - sum(taken.values()))
    rest = [s for s in strata if s not in take_all]
    for i, s in enumerate(rest):
        left = budget - sum(taken.values())
        share = -(-left // (len(rest) - i))
        taken[s] = max(0, min(available.get(s, 0), share, left))
    return taken


def allocation(available: DataFrame, budget: int, strata: tuple[str, ...] = DENSITY_ORDER, take_all: tuple[str, ...] = ()) -> DataFrame:
    """``stratum, available, taken, p``: ``allocate`` as one expression over an array with a row for each stratum."""
    order = [*(s for s in strata if s in take_all), *(s for s in strata if s not in take_all)]
    one = available.agg(*(F.coalesce(F.max(F.when(F.col("stratum") == s, F.col("available"))), F.lit(0)).cast("long").alias(s) for s in order))
    rows = F.array(*(F.struct(F.lit(s).alias("stratum"), F.col(s).alias("available"), F.lit(1 if s in take_all else len(order) - i).cast("long").alias("shares")) for i, s in enumerate(order)))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.expr("cast(array() as array<struct<stratum:string,available:bigint,taken:bigint>>)").alias("out"))

    def step(state: Column, x: Column) -> Column:
        want = F.greatest(F.lit(0), F.least(x.available, F.ceil(state.left / x.shares), state.left)).cast("long")
        return F.struct((state.left - want).alias("left"), F.array_append(state.out, F.struct(x.stratum.alias("stratum"), x.available.alias("available"), want.alias("taken"))).alias("out"))

    done = one.select(F.explode(F.aggregate(rows, start, step, lambda s: s.out)).alias("r")).select("r.*")
    return done.withColumn("p", F.coalesce(F.try_divide("taken", "available"), F.lit(0.0)))


def spread(rows: DataFrame, wanted: dict[str, int], stratum: str, video: str = "video_id", key: str = "comment_id", seed: int = SEED) -> DataFrame:
    """``wanted`` rows of each stratum, round-robin over videos, the largest video first in each round.

    A row's round is its place within its video; only as many rounds as rows are wanted can matter, which
    the plan cuts off before it shuffles, and each stratum is then a top-k, not a sort of all.
    """
    wanted = {s: n for s, n in wanted.items() if n > 0}
    most = max(wanted.values(), default=0)
    sizes = rows.groupBy(stratum, video).agg(F.count("*").alias("_size"))
    rounds = rows.withColumn("_round", F.row_number().over(Window.partitionBy(stratum, video).orderBy(shuffled(key, seed), key))).where(F.col("_round") <= most)
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("_round", F.desc("_size"), video))
    ranked = rounds.join(sizes, [stratum, video]).withColumn("_place", place).where(F.col("_place") <= most)
    enough = F.lit(0)
    for s, n in wanted.items():
        enough = F.when(F.col(stratum) == s, n).otherwise(enough)
    return ranked.where(F.col("_place") <= enough).select(*rows.columns)


def enriched_draw(pool: DataFrame, natural: DataFrame, budget: int, stratum: str = "density", strata: tuple[str, ...] = DENSITY_ORDER, take_all: tuple[str, ...] = (), include_short: bool = False, seed: int = SEED) -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """The enriched sample, and (available, taken) of each stratum.  ``pool`` is read several times and should be stored and narrow."""
    rest = pool.join(natural.select("comment_id"), "comment_id", "left_anti")
    if not include_short:
        rest = rest.where("density_eligible")
    available = {r[0]: r[1] for r in rest.groupBy(stratum).count().collect()}  # a row for each stratum
    taken = allocate(available, budget, strata, take_all)
    return spread(rest, taken, stratum, seed=seed), {s: (available.get(s, 0), n) for s, n in taken.items()}


def retest_draw(sample: DataFrame, n: int, stratum: str = "density", key: str = "comment_id", seed: int = SEED) -> DataFrame:
    """A re-draw of ``n`` of the sample: an even number of each stratum, topped up from the others.

    At least one of each stratum, so more than ``n`` if there are more strata.
    """
    order = (shuffled(key, seed + 1), F.col(key))
    n_strata = F.size(F.collect_set(stratum).over(Window.partitionBy()))
    whole = F.least(F.lit(n), F.count("*").over(Window.partitionBy()))
    numbered = sample.withColumns({"_k": F.row_number().over(Window.partitionBy(stratum).orderBy(*order)), "_per": F.greatest(F.lit(1), F.floor(whole / n_strata)), "_n": whole})
    first = F.col("_k") <= F.col("_per")
    ranked = numbered.withColumns({"_first": first, "_picked": F.count_if(first).over(Window.partitionBy())}).withColumn("_rest", F.row_number().over(Window.partitionBy("_first").orderBy(*order)))
    return ranked.where(F.col("_first") | (F.col("_rest") <= F.col("_n") - F.col("_picked"))).select(*sample.columns)


def batches(sample: DataFrame, prefix: str, size: int, seed: int = SEED, key: str = "comment_id") -> DataFrame:
    """``sample`` with ``batch``: prefix_01, prefix_02, ... of ``size`` rows in random order."""
    number = F.floor((F.row_number().over(Window.orderBy(shuffled(key, seed), key)) - 1) / size) + 1
    return sample.withColumn("batch", F.concat(F.lit(prefix + "_"), F.when(number < 100, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string"))))


def manifest(natural: DataFrame, enriched: DataFrame, retest: DataFrame, pool_size: int, strata: dict[str, tuple[int, int]], stratum: str = "density") -> DataFrame:
    """One row for each (comment, sample), with the inclusion probability to six places; "" for retests."""
    columns = ["comment_id", "batch", "sample", "stratum", "screen_bucket", "video_id", "n_tokens", "density_eligible", "inclusion_prob"]

    def six(x: Column) -> Column:
        return F.format_string("%.6f", x.cast("double"))

    p = F.lit(0.0)
    for s, (available, taken) in strata.items():
        p = F.when(F.col(stratum) == s, taken / available if available else 0.0).otherwise(p)
    share = six(F.count("*").over(Window.partitionBy()) / F.lit(pool_size))
    parts = [(natural, "natural", share), (enriched, "enriched", six(p)), (retest, "retest", F.lit(""))]
    return reduce(DataFrame.unionByName, (df.withColumns({"sample": F.lit(name), "stratum": F.col(stratum), "inclusion_prob": prob}).select(*columns) for df, name, prob in parts))


def coverage(sample: DataFrame) -> DataFrame:
    """``n, videos, largest_share``: how widely a sample spreads over videos."""
    return sample.groupBy("video_id").count().agg(F.sum("count").alias("n"), F.count("*").alias("videos"), (F.max("count") / F.sum("count")).alias("largest_share"))


def pilot(rows: DataFrame, n: int, mixed_share: float = 0.0, seed: int = 42) -> DataFrame:
    """A pilot batch; ``mixed_share`` of it from mixed texts (``screen_bucket``) if that is over 0."""
    order = (shuffled("comment_id", seed), F.col("comment_id"))
    if mixed_share <= 0:
        return rows.orderBy(*order).limit(n)
    mixed = F.col("screen_bucket").isin("low", "med", "high")
    first = rows.where(mixed).orderBy(*order).limit(int(n * mixed_share))
    number = F.row_number().over(Window.orderBy(*order))
    other = rows.where(~mixed).orderBy(*order).limit(n).withColumn("_k", number)
    got = first.agg(F.count("*").alias("_got"))
    return first.unionByName(other.crossJoin(F.broadcast(got)).where(F.col("_k") <= n - F.col("_got")).select(*rows.columns))  # one row


def first_of_each(rows: DataFrame, group: str, n: int, order: str = "seq") -> DataFrame:
    """The first ``n // 3 + 1`` rows of each group, as examples."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_k") <= n // 3 + 1).drop("_k")


def spot_check(accepted: DataFrame, rate: float = 0.12, seed: int = SEED) -> DataFrame:
    """All low-confidence rows and ``rate`` of the others, rounded half to even, at random."""
    high = accepted.where("confidence = 'high'")
    n = round(high.count() * rate)
    return accepted.where("confidence = 'low'").unionByName(high.orderBy(shuffled("id", seed), "id").limit(n))


def pilot_passes(batch: DataFrame, seed: int = 42) -> DataFrame:
    """The batch with two orders, ``pass1`` and ``pass2``: the same rows, to be annotated twice."""
    return batch.withColumns({f"pass{k + 1}": F.row_number().over(Window.orderBy(shuffled("comment_id", seed + k), "comment_id")) for k in range(2)})


def strata_pool(clean: DataFrame, model: DensityModel) -> DataFrame:
    """The clean corpus (seq, text, ...) with measured density, ``measured_base_lang`` and ``minority_share``; no evidence counts as mono."""
    measured = measure(clean.select("seq", "text"), model).select("seq", F.when(F.col("density") == "", "mono").otherwise(F.col("density")).alias("density"), F.col("base_lang").alias("measured_base_lang"), "minority_share")
    return clean.join(measured, "seq")
