"""Stored adjacency: equal to the graph it was written from, and joined without moving it."""

import random

from pyspark.sql import functions as F

from stratalens import sinks
from stratalens.operators import graph


def test_stored_neighbours(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}", rng.choice(["CALLS", "IMPORTS"]), rng.choice(["code", "change"])) for _ in range(90)]
    edges = spark.createDataFrame(rows, "src string, dst string, type string, layer string")
    table = sinks.write_adjacency(edges, "adjacency_test", str(tmp_path / "adjacency"), buckets=4)
    try:
        starts = spark.createDataFrame([("n1",), ("n7",)], "start string")
        for direction in ("out", "in", "both"):
            for types, layers in ((None, None), (["CALLS"], ["code"])):
                want = graph.neighbours(edges if layers is None else edges.where(F.col("layer").isin(layers)), starts, 2, types, direction)
                got = graph.neighbours_stored(table, starts, 2, types, direction, layers)
                assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
        step = starts.select(F.col("start").alias("u")).join(table.where("layer = 'code'").select("u", "v").hint("merge"), "u")
        plan = step._jdf.queryExecution().executedPlan().toString()
        scan = plan[: plan.index("FileScan parquet")].rsplit("\n", 8)
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "layer" in plan[plan.index("PartitionFilters") :].split("]")[0], scan
    finally:
        spark.sql("DROP TABLE adjacency_test")
