"""Range joins: which intervals hold a point, and the narrowest of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import spread

#: Width of the buckets that intervals and points are dealt to.
BUCKET = 256


def containing(points: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, end: str, bucket: int | None = BUCKET) -> DataFrame:
    """points joined with the intervals of the same key that hold them (both ends included).

    Each interval is dealt to the buckets it spans and the join is on (key, bucket), so a key with many intervals isn't
    compared as a whole. Without a bucket width (None) the join is on the key alone.
    """
    return _dealt(points, intervals, on, point, start, end, bucket).drop("_bucket")


def _dealt(points: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, end: str, bucket: int | None) -> DataFrame:
    """``containing`` with the _bucket that rows are partitioned by beside the key."""
    if bucket is None:
        return points.join(intervals, on).where(F.col(point).between(F.col(start), F.col(end)))
    dealt = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    rows, by = points.count() + intervals.count(), [*on, "_bucket"]
    held = spread(points.withColumn("_bucket", F.floor(F.col(point) / bucket)), rows, *by).join(spread(dealt, rows, *by), by)
    return held.where(F.col(point).between(F.col(start), F.col(end)))


def innermost(points: DataFrame, intervals: DataFrame, on: list[str], point: str, start: str, end: str, tie: list[str], point_key: list[str], bucket: int | None = BUCKET) -> DataFrame:
    """For each point the narrowest interval that holds it; the first by ``tie`` of equally narrow ones.

    A point's key fixes its join key and bucket, so the window takes rows where the join left them.
    """
    w = Window.partitionBy(*dict.fromkeys([*point_key, *on, *(["_bucket"] if bucket is not None else [])])).orderBy((F.col(end) - F.col(start)).asc(), *tie)
    return _dealt(points, intervals, on, point, start, end, bucket).withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_bucket")


def hunk_symbols(hunks: DataFrame, symbols: DataFrame, key: list[str]) -> DataFrame:
    """key, symbols: sorted distinct innermost symbols over the lines that each hunk changes on its new side.

    hunks: key, file, new_start, new_lines. symbols: file, qualified, line_start, line_end, ord.
    """
    probes = hunks.select(*key, "file", F.explode(F.expr("sequence(new_start, new_start + greatest(new_lines - 1, 0))")).alias("line"))
    found = innermost(probes, symbols, ["file"], "line", "line_start", "line_end", ["ord"], [*key, "file", "line"])
    return spread(found, hunks.count(), *key).groupBy(*key).agg(F.array_sort(F.collect_set("qualified")).alias("symbols"))
