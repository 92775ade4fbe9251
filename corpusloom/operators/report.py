"""Markdown reports from aggregated tables; what is collected has a row for each reason, bucket or test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import corpus as C
from . import evaluation as E
from .sampling import coverage

ORDER = ("mono", "low", "med", "high", "unknown")


def table(header: list[str], rows: list[list]) -> str:
    lines = [header, ["---"] * len(header), *rows]
    return "\n".join("| " + " | ".join("-" if x is None else str(x) for x in r) + " |" for r in lines)


def _by(rows, key: str) -> dict:
    return {r[key]: r for r in rows}


def corpus_report(done: DataFrame) -> str:
    """Input by file, drops by reason, pools and buckets of a built corpus."""
    whole = done.count()
    files = sorted(C.input_counts(done).collect(), key=lambda r: (r.source_file == "total", r.source_file))
    drops = sorted(C.drop_report(done).collect(), key=lambda r: (r.drop_reason == "total", -r.n, r.drop_reason))
    pools = _by(done.groupBy("pool").agg(F.count("*").alias("n"), F.count_if("density_eligible").alias("eligible")).collect(), "pool")
    buckets = _by(C.bucket_report(done).collect(), "screen_bucket")
    clean = pools.get("clean")
    mixed = sum(buckets[b].eligible for b in ("med", "high") if b in buckets)
    return "\n\n".join(
        [
            "# Corpus",
            "## Input\n\n" + table(["source file", "rows"], [[r.source_file, r.n] for r in files]),
            "## Dropped\n\n" + table(["reason", "rows", "% of input"], [[r.drop_reason, r.n, f"{100 * r.n / max(whole, 1):.1f}"] for r in drops]),
            "## Kept\n\n" + table(["pool", "rows"], [["clean", clean.n if clean else 0], ["of which eligible for density", clean.eligible if clean else 0], ["romanized", pools["romanized"].n if "romanized" in pools else 0]]),
            "## Screen buckets of the clean pool\n\n" + table(["bucket", "all", "eligible"], [[b, buckets[b].n if b in buckets else 0, buckets[b].eligible if b in buckets else 0] for b in ORDER]),
            f"Eligible rows screened med or high: {mixed}.",
        ]
    )


def sampling_report(pool_size: int, natural: DataFrame, enriched: DataFrame, retest: DataFrame, strata: dict[str, tuple[int, int]], seed: int) -> str:
    """Sizes, inclusion probabilities and coverage of a draw."""
    sizes = {"natural": natural.count(), "enriched": enriched.count(), "retest": retest.count()}
    rows = [["natural", "(all)", pool_size, sizes["natural"], f"{sizes['natural'] / max(pool_size, 1):.4f}"]]
    rows += [["enriched", s, a, t, f"{t / a if a else 0:.4f}"] for s, (a, t) in strata.items()]
    spread = []
    for name, df in (("natural", natural), ("enriched", enriched)):
        c = coverage(df).first()
        spread.append(f"- {name}: {c.n or 0} rows over {c.videos} videos; the largest gives {100 * (c.largest_share or 0):.1f} %.")
    return "\n\n".join(
        [
            f"# Sample (seed {seed})",
            table(["part", "rows"], [["pool", pool_size], *sizes.items(), ["to annotate", sizes["natural"] + sizes["enriched"]]]),
            "## Inclusion probabilities\n\n" + table(["sample", "stratum", "available", "taken", "p"], rows),
            "## Videos\n\n" + "\n".join(spread),
        ]
    )


def comparison_report(predictions: DataFrame, classifier: str | None = None) -> str:
    """Overall and bucketed scores, margins, significance, length control and the best one's confusions."""
    p = E.aligned(E.one_classifier(predictions, classifier))
    overall = sorted(E.overall(p).collect(), key=lambda r: r.representation)
    if not overall:
        raise ValueError("no predictions that all representations share")
    best_row = E.best_representation(E.overall(p))
    best = best_row.first().best
    bucketed = E.by_bucket(p)
    cells = {(r.density, r.representation): r for r in bucketed.collect()}
    margins = _by(E.margins(bucketed, best_row).collect(), "density")
    tests = sorted(E.significance(p).collect(), key=lambda r: (r.a, r.b, r.scope != "all", r.scope))
    lengths = _by(E.length_control(p).collect(), "density")
    reps = [r.representation for r in overall]
    buckets = [b for b in E.BUCKETS if any((b, r) in cells for r in reps)]
    confusion = E.confusion_matrix(p.where(F.col("representation") == best)).collect()
    parts = [
        "# Representations",
        "## Overall\n\n" + table(["representation", "macro-F1", "accuracy", "above floor"], [[r.representation, f"{r.macro_f1:.3f}", f"{r.accuracy:.3f}", f"{r.above_floor:+.3f}"] for r in overall]),
        f"Best: {best}. Majority class: {overall[0].majority}, {overall[0].floor:.3f} of all.",
        "## By density\n\n" + table(["bucket", "n", "floor", *reps], [[b + (" (thin)" if cells[b, reps[0]].thin else ""), cells[b, reps[0]].n, f"{cells[b, reps[0]].floor:.3f}", *(f"{cells[b, r].macro_f1:.3f}" for r in reps)] for b in buckets]),
    ]
    if len(reps) > 1:
        parts.append("## Margin of the best\n\n" + table(["bucket", "n", best, "best of the rest", "margin"], [[b, margins[b].n, f"{margins[b].best_f1:.3f}", f"{margins[b].rest_f1:.3f}", f"{margins[b].margin:+.3f}"] for b in buckets]))
        rows = [[f"{t.a} vs {t.b}", t.scope, t.n, t.n01, t.n10, f"{t.p:.4f}", f"{t.p_holm:.4f}", "significant" if t.significant else ""] for t in tests]
        parts.append("## Significance\n\n" + (table(["pair", "scope", "n", "n01", "n10", "p", "p (Holm)", ""], rows) if rows else "Too few comments for any test."))
    parts.append("## Length\n\n" + table(["bucket", "n", "median tokens", "mean"], [[b, lengths[b].n, f"{lengths[b].median_tokens:.0f}", f"{lengths[b].mean_tokens:.1f}"] for b in buckets]))
    parts.append(f"## Confusions of {best}\n\n" + table(["gold", *E.LABELS], [[r.gold, *(r[x] for x in E.LABELS)] for r in confusion]))
    return "\n\n".join(parts)
