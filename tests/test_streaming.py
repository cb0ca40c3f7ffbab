import datetime as dt
import random

from stratalens.functions import fixed
from stratalens.operators import lifecycle
from stratalens.streaming import trace


def test_trace_counts_stream_equals_batch(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h % 24, m), ["code", "change"][m % 2], ["ok", "failed"][h % 2]) for h in range(5) for m in range(6)]
    spark.createDataFrame(rows, "ts timestamp, layer string, status string").write.parquet(str(tmp_path / "in"))
    batch = trace.trace_counts(spark.read.parquet(str(tmp_path / "in")))
    stream = spark.readStream.schema("ts timestamp, layer string, status string").parquet(str(tmp_path / "in"))
    q = trace.trace_counts(stream).writeStream.format("memory").queryName("traces").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("traces").collect())) == sorted(map(tuple, batch.collect()))


def test_transitions(spark, tmp_path):
    rows = [("a", 1, "PLANNED"), ("a", 2, "PREPARED"), ("a", 3, "VERIFIED"), ("a", 4, "PATCH_BUILT"), ("b", 1, "PLANNED"), ("b", 2, "STALE_PLAN"), ("b", 3, "PREPARED")]
    spark.createDataFrame(rows, "execution_id string, ord bigint, status string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("execution_id string, ord bigint, status string").parquet(str(tmp_path / "in"))
    q = trace.run_available(trace.checked_transitions(stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(120)
    got = {(r.execution_id, r.next): r.legal for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "PLANNED"): True, ("a", "PREPARED"): True, ("a", "VERIFIED"): False, ("a", "PATCH_BUILT"): True, ("b", "PLANNED"): True, ("b", "STALE_PLAN"): True, ("b", "PREPARED"): False}
    bad = lifecycle.illegal_transitions(spark.read.parquet(str(tmp_path / "in")), lifecycle.transition_table(spark)).collect()
    assert {(r.execution_id, r.prev, r.next) for r in bad} == {("a", "PREPARED", "VERIFIED"), ("a", "VERIFIED", "PATCH_BUILT"), ("b", "STALE_PLAN", "PREPARED")}


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def files(spark, path, schema, *parts):
    """A stream of one file a batch, in order."""
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / f"{k:03d}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def done(df, tmp_path, spark):
    q = trace.run_available(df, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert q.awaitTermination(240)
    return spark.read.parquet(str(tmp_path / "out"))


EVENT = "run string, trace_id string, ts timestamp, kind string, text string"


def test_spans_of_a_stream_out_of_order(spark, tmp_path):
    parts = [
        [("r", "b", at(3), "end", None), ("r", "a", at(0), "begin", None), ("r", "never", at(1), "begin", None)],
        [("r", "b", at(2), "begin", None), ("q", "a", at(4), "end", "failed")],
        [("r", "a", at(9), "end", "failed"), ("q", "a", at(1), "begin", None), ("r", "a", at(11), "begin", None)],
        [("r", "a", at(12), "end", None), ("r", "clock", at(300), "begin", None), ("r", "clock", at(300), "end", None)],
        [("r", "tick", at(301), "begin", None), ("r", "tick", at(301), "end", None)],
    ]
    stream = files(spark, tmp_path / "in", EVENT, *parts)
    got = {(r.run, r.trace_id, r.began): (r.status, r.duration_ms) for r in done(trace.spans(stream, "10 minutes", "20 minutes"), tmp_path, spark).collect()}
    minute = 60_000
    want = {("r", "b", at(2)): ("ok", minute), ("r", "a", at(0)): ("failed", 9 * minute), ("q", "a", at(1)): ("failed", 3 * minute), ("r", "a", at(11)): ("ok", minute), ("r", "never", at(1)): ("running", None), ("r", "clock", at(300)): ("ok", 0), ("r", "tick", at(301)): ("ok", 0)}
    assert got == want
    batch = trace.spans(spark.read.schema(EVENT).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in")), "10 minutes").collect()
    assert {(r.run, r.trace_id, r.began): (r.status, r.duration_ms) for r in batch} == want


def test_all_states_and_expiry(spark, tmp_path):
    rng = random.Random(3)
    states = [*fixed.CHAIN, *fixed.FAILURES]
    assert len(states) == 15
    allowed = set(zip(fixed.CHAIN, fixed.CHAIN[1:], strict=False)) | {(s, f) for f, sources in fixed.FAILURES.items() for s in sources}
    rows, want = [], {}
    for k in range(60):
        current = None
        for n in range(12):
            legal = sorted(b for a, b in allowed if a == current) or ["PLANNED"]
            onward, r = dict(zip(fixed.CHAIN, fixed.CHAIN[1:], strict=False)).get(current), rng.random()
            status = onward if onward and r < 0.75 else rng.choice(legal if r < 0.92 else states)
            ok = status == "PLANNED" if current is None else (current, status) in allowed
            want[f"e{k}", n] = (current, status, ok)
            current = status if ok else current
            rows.append((f"e{k}", n, status, at(n)))
    schema = "execution_id string, ord bigint, status string, ts timestamp"
    rest = [[("clock", 0, "PLANNED", at(500))], [("clock", 1, "PREPARED", at(501))]]
    stream = files(spark, tmp_path / "in", schema, [r for r in rows if r[1] < 6], [r for r in rows if r[1] >= 6], *rest)
    got = done(trace.checked_transitions(stream, "2 hours"), tmp_path, spark).collect()
    steps = sorted((r.execution_id, str(r.prev), r.next, r.legal) for r in got if r.next != "EXPIRED" and r.execution_id != "clock")
    assert steps == sorted((e, str(a), b, ok) for (e, _), (a, b, ok) in want.items())
    assert {b for _, b, ok in want.values() if ok} == set(states)
    final = set(fixed.FAILURES) | {"PROMOTED"}
    last = {}
    for (e, n), (a, b, ok) in sorted(want.items()):
        last[e] = b if ok else a
    assert {(r.execution_id, r.prev) for r in got if r.next == "EXPIRED"} == {(e, s) for e, s in last.items() if s not in final and s is not None}
