"""Trace events and attempts as streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from stratalens.functions import fixed


def trace_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """start, layer, events, failed for each window; events later than the watermark are left out.

    events: ts (timestamp), layer, status.
    """
    w = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = w.groupBy(F.window("ts", window).alias("w"), "layer").agg(F.count("*").alias("events"), F.count_if(F.col("status") == "failed").alias("failed"))
    return counts.select(F.col("w.start").alias("start"), "layer", "events", "failed")


def spans(events: DataFrame, longest: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """run, trace_id, began, ended, status, duration_ms: a row for each span of a stream (or table) of events.

    events: run, trace_id, ts, kind (begin or end), text (an end's status, ok if null). Begins and ends of one id are
    joined whatever order they arrive in, as long as none is later than the watermark; a span that hasn't ended after
    ``longest`` is given up as running, once the watermark is past that. An id may come again after ``longest``; sooner, its
    begins would meet each other's ends.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    begins = e.where("kind = 'begin'").select("run", "trace_id", F.col("ts").alias("began")).withWatermark("began", late)
    ends = e.where("kind = 'end'").select(F.col("run").alias("_run"), F.col("trace_id").alias("_id"), F.col("ts").alias("ended"), F.coalesce("text", F.lit("ok")).alias("_status")).withWatermark("ended", late)
    same = (F.col("run") == F.col("_run")) & (F.col("trace_id") == F.col("_id")) & (F.col("ended") >= F.col("began")) & (F.col("ended") <= F.col("began") + F.expr(f"INTERVAL {longest}"))
    both = begins.join(ends, same, "leftOuter")
    ms = (F.unix_millis("ended") - F.unix_millis("began")).alias("duration_ms")
    return both.select("run", "trace_id", "began", "ended", F.coalesce("_status", F.lit("running")).alias("status"), ms)


def checked_transitions(history: DataFrame, stuck: str | None = None, late: str = "0 seconds") -> DataFrame:
    """execution_id, prev, next, legal: each attempt's steps judged as they arrive; an illegal one leaves the state alone.

    history: execution_id, ord (bigint), status. State is one status for each attempt. With ``stuck`` (an interval) history
    has ts (timestamp) as well: an attempt that isn't in a final state and hasn't moved for so long, as the watermark
    tells, gets a row with next EXPIRED, and its state goes.
    """
    steps = {a: {b} for a, b in zip(fixed.CHAIN, fixed.CHAIN[1:], strict=False)}
    for failure, sources in fixed.FAILURES.items():
        for s in sources:
            steps.setdefault(s, set()).add(failure)
    wait = None if stuck is None else int(history.sparkSession.range(1).select((F.unix_millis(F.lit("1970-01-01").cast("timestamp") + F.expr(f"INTERVAL {stuck}")) - F.unix_millis(F.lit("1970-01-01").cast("timestamp"))).alias("w")).first().w)

    def judge(key: tuple, batches: Iterator, state: GroupState):
        import pandas as pd

        columns = ["execution_id", "prev", "next", "legal"]
        current, moved = state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], current, "EXPIRED", False)], columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values("ord")
        out = []
        for k, status in enumerate(rows["status"]):
            legal = status == fixed.CHAIN[0] if current is None else status in steps.get(current, set())
            out.append((key[0], current, status, legal))
            if legal:
                current = status
                moved = max(moved, rows["ts"].iloc[k].value // 10**6 if wait is not None else 0)
        if current is not None:
            state.update((current, moved))
            if wait is not None and current in steps:
                state.setTimeoutTimestamp(max(moved + wait, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=columns)

    kind = history.schema["execution_id"].dataType.simpleString()
    timeout = GroupStateTimeout.NoTimeout
    if wait is not None:
        history, timeout = history.withWatermark("ts", late), GroupStateTimeout.EventTimeTimeout
    return history.groupBy("execution_id").applyInPandasWithState(judge, f"execution_id {kind}, prev string, next string, legal boolean", "status string, moved bigint", "append", timeout)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there now and stop; the checkpoint lets the next run go on."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
