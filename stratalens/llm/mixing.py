"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, small_batches

#: Places of the inverted distribution: P(count > 64) is under 1e-17 up to a mean of 16, which rates are cut to by splitting.
MOST_RATE = 16.0
TERMS = 64


def uniform(*keys: Column, seed: str) -> Column:
    """A number in [0, 1) from the first 13 hex digits of an MD5 over the keys and a seed; any engine can recompute it."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("\x00")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def order_key(doc_id: Column, copy: Column, seed: str) -> Column:
    """The place of a document's copy in the global shuffle: 16 hex digits of an MD5 of seed, doc_id and copy."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("\x00")), copy.cast("string"), F.lit("order"))), 1, 16)


def range_of(key: str, parts: int) -> Column:
    """Which of so many equal ranges a uniform key of hex digits falls into, from its first 7."""
    return F.floor(F.conv(F.substring(key, 1, 7), 16, 10).cast("bigint") * parts / (1 << 28)).cast("int")


def poisson(rate: Column, u: Column) -> Column:
    """The count k at which a Poisson distribution of this mean first reaches beyond u."""
    # u is carried along, since an expression inside the steps would be hashed anew in each of them
    start = F.struct(F.lit(0).alias("k"), F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), u.alias("u"))

    def step(x, i):
        on = x.cdf <= x.u
        p = x.p * rate / i
        return F.struct(F.when(on, i.cast("int")).otherwise(x.k).alias("k"), p.alias("p"), F.when(on, x.cdf + p).otherwise(x.cdf).alias("cdf"), x.u.alias("u"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda x: x.k)


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0) -> DataFrame:
    """source_key, n, rate: mean repetitions that bring each source to its share of ``size`` times the rows.

    weights are target shares by source, scaled to sum to 1 over the sources that occur; without them a source's target
    is in proportion to its rows to the power ``temperature``. Sources that weights don't name get rate 0. A null source
    is a source of its own, named by None. One row for each source: counts are combined before the shuffle.
    """
    counts = docs.groupBy(col(source).alias("source_key")).agg(F.count("*").alias("n"))
    if weights is None:
        target = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        target = F.lit(0.0)
        for name, w in weights.items():
            target = F.when(F.col("source_key").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(target)
    counts = counts.withColumn("target", target)
    totals = counts.agg(F.sum("target").alias("all_target"), F.sum("n").alias("all_n"))
    return counts.crossJoin(F.broadcast(totals)).select("source_key", "n", F.coalesce(F.try_divide(F.col("target") * F.col("all_n") * size, F.col("all_target") * F.col("n")), F.lit(0.0)).alias("rate"))  # one row of totals


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5, size: float = 1.0, seed: str = "mix", columns: bool = True) -> DataFrame:
    """docs with each row repeated by a Poisson count of its source's rate, plus copy (0, 1, ...) and mix_key.

    The count inverts the Poisson distribution at a number hashed from seed and doc_id, so it doesn't depend on
    partitions or lost executors and its mean is the rate. Rates over MOST_RATE are split into a whole number of equal
    draws. Rows are sorted by mix_key, a hash of (seed, doc_id, copy), over partitions that are its ranges: a global
    shuffle whose order is (mix_key, doc_id, copy). The key is uniform, so ranges follow from its leading digits and
    nothing is sampled; there are ``spark.sql.shuffle.partitions`` of them. Null ids hash as one id; repeated rows get equal
    counts. Columns of docs named copy or mix_key are replaced. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    origin, rate, draws, count = free_name(docs, "_source", "_rate", "_draws", "_count")
    rates = source_rates(docs, source, weights, temperature, size).select(F.col("source_key").alias(origin), F.col("rate").alias(rate))
    keep = [c for c in docs.columns if c.lower() not in ("copy", "mix_key")]
    rated = docs.join(F.broadcast(rates), col(source).eqNullSafe(F.col(origin))) if _few(rates) else docs.join(rates, col(source).eqNullSafe(F.col(origin)))
    n = F.greatest(F.ceil(F.col(rate) / MOST_RATE), F.lit(1)).cast("int")
    one = F.col(rate) / n
    total = F.aggregate(F.sequence(F.lit(1), F.col(draws)), F.lit(0), lambda s, i: s + poisson(one, uniform(col(doc_id), i, seed=seed)))
    out = rated.withColumn(draws, n).withColumn(count, total).where(F.col(count) > 0)
    out = out.select(*[col(c) for c in keep], F.explode(F.sequence(F.lit(0), F.col(count) - 1)).alias("copy"))
    out = out.withColumn("mix_key", order_key(col(doc_id), F.col("copy"), seed))
    return out.repartitionById(parts := int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), range_of("mix_key", parts)).sortWithinPartitions("mix_key", col(doc_id), "copy")


def _few(rates: DataFrame, most: int = 100_000) -> bool:
    """Whether the table of sources is small enough to broadcast; it is counted, not assumed."""
    return rates.limit(most + 1).count() <= most
