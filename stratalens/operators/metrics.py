"""Precision, recall and their kin over sets, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def set_counts(pred: DataFrame, gold: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """by, tp, n_pred, n_gold over distinct keys, in one full outer join and one aggregate."""
    p = pred.select(*by, *key).distinct().withColumn("_p", F.lit(1))
    g = gold.select(*by, *key).distinct().withColumn("_g", F.lit(1))
    both = p.join(g, [*by, *key], "full_outer")
    sums = [F.count_if(F.col("_p").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count("_p").alias("n_pred"), F.count("_g").alias("n_gold")]
    return both.groupBy(*by).agg(*sums) if by else both.agg(*sums)


def _ratio(a: Column, b: Column, empty: Column | float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, F.nullif(b, F.lit(0))), F.lit(empty) if isinstance(empty, float) else empty)


def prf(counts: DataFrame, variant: str = "strict") -> DataFrame:
    """counts with precision, recall, f1.

    strict: empty sets give 0; four places. lenient: no predictions give precision 0, and recall 1 if there is no gold
    either; no gold gives recall 1; three places. goldhit: no gold gives recall 1, and precision 1 if nothing was predicted;
    three places.
    """
    tp, n_pred, n_gold = F.col("tp"), F.col("n_pred"), F.col("n_gold")
    p, r, places = _ratio(tp, n_pred), _ratio(tp, n_gold), 4
    if variant == "lenient":
        r, places = _ratio(tp, n_gold, 1.0), 3
    elif variant == "goldhit":
        p, r, places = F.when(n_gold == 0, (n_pred == 0).cast("double")).otherwise(p), _ratio(tp, n_gold, 1.0), 3
    f1 = _ratio(2 * p * r, p + r)
    return counts.withColumn("precision", F.round(p, places)).withColumn("recall", F.round(r, places)).withColumn("f1", F.round(f1, places))


def at_k(ranked: DataFrame, gold: DataFrame, by: list[str], item: str, order: list[Column], k: int) -> DataFrame:
    """Precision and recall over the distinct items of the first k candidates."""
    top = ranked.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rank") <= k)
    return prf(set_counts(top, gold, by, [item])).withColumn("k", F.lit(k))


def preservation(rollback: DataFrame, pred_keep: DataFrame, gold_keep: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, preservation, preservation_kept, collateral: of what must be kept, the share predicted kept and not rolled back;
    the share not rolled back; and how many were rolled back."""
    g = gold_keep.select(*by, key).distinct()
    rb = rollback.select(*by, key).distinct().withColumn("_r", F.lit(1))
    kp = pred_keep.select(*by, key).distinct().withColumn("_k", F.lit(1))
    j = g.join(rb, [*by, key], "left").join(kp, [*by, key], "left")
    hit, kept = F.count("_r"), F.count_if(F.col("_k").isNotNull() & F.col("_r").isNull())
    return j.groupBy(*by).agg(F.round(kept / F.count("*"), 4).alias("preservation"), F.round(1 - hit / F.count("*"), 4).alias("preservation_kept"), hit.alias("collateral"))


def tolerant_hits(gold: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """by, gold: gold symbols that contain, or are contained in, a predicted one or have its short name, and commits equal in
    eight characters."""
    j = gold.join(pred, by)
    short = lambda c: F.element_at(F.split(c, "::"), -1)
    ok = (short("gold") == short("pred")) | F.contains("gold", F.col("pred")) | F.contains("pred", F.col("gold")) | (F.col("gold").rlike("^[0-9a-f]{8,}$") & F.startswith("pred", F.left("gold", F.lit(8))))
    return j.where(ok).select(*by, "gold").distinct()


def exact_hits(gold: DataFrame, pred: DataFrame, by: list[str]) -> DataFrame:
    """by, gold: gold files that are predicted under just that path."""
    return gold.select(*by, "gold").distinct().join(pred.select(*by, F.col("pred").alias("gold")), [*by, "gold"], "left_semi")


def label_accuracy(rows: DataFrame, arm: str = "arm") -> DataFrame:
    """arm, units, label_accuracy, mapping_accuracy (over the units that have a mapping), coverage: rows of label, gold and
    mapped (null without a mapping), rounded to three places."""
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 3)
    return rows.groupBy(arm).agg(F.count("*").alias("units"), share(F.coalesce(F.col("label") == F.col("gold"), F.lit(False))).alias("label_accuracy"), share(F.col("mapped")).alias("mapping_accuracy"), share(F.col("mapped").isNotNull()).alias("coverage"))


def macro_means(scores: DataFrame, by: list[str], metrics: list[str], places: int = 4) -> DataFrame:
    """Mean of each named metric over the rows that have it."""
    return scores.groupBy(*by).agg(*[F.round(F.avg(F.col(m).cast("double")), places).alias(m) for m in metrics])


def mean_table(scores: DataFrame, by: list[str], pivot: str, metric: str) -> DataFrame:
    """One column for each value of pivot with the mean of a metric."""
    return scores.groupBy(*by).pivot(pivot).agg(F.round(F.avg(metric), 4))


def stop_histogram(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.coalesce("stopped_at", F.lit("finished")).alias("stopped_at")).agg(F.count("*").alias("n"))


def ablation_summary(rows: DataFrame, arm: str = "arm") -> DataFrame:
    """arm, recall_1, recall_3, mapping_accuracy, unresolved, tokens: conditional means, rounded to three places."""
    r = lambda c: F.round(F.avg(c), 3)
    return rows.groupBy(arm).agg(r((F.coalesce("rank", F.lit(99)) == 1).cast("double")).alias("recall_1"), r((F.coalesce("rank", F.lit(99)) <= 3).cast("double")).alias("recall_3"), r(F.col("mapped_ok").cast("double")).alias("mapping_accuracy"), r(F.col("rank").isNull().cast("double")).alias("unresolved"), F.sum("tokens").alias("tokens"))


def trace_summary(events: DataFrame) -> DataFrame:
    """layer, events, failed."""
    return events.groupBy("layer").agg(F.count("*").alias("events"), F.count_if(F.col("status") == "failed").alias("failed"))
