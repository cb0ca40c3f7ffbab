"""Records appear on commit, whole, and once."""

import pytest
from pyspark.sql import functions as F

from stratalens.sinks.ledger import LedgerSink, read_ledger

SCHEMA = "execution_id string, ord bigint, status string, tags array<string>"


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(LedgerSink)
    at = str(tmp_path / "ledger")
    assert read_ledger(spark, at, SCHEMA).count() == 0
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("e"), F.col("id").cast("string")).alias("execution_id"), F.col("id").alias("ord"), F.lit("计划").alias("status"), F.array(F.lit("a")).alias("tags"))
    rows.write.format("ledger").option("path", at).mode("append").save()
    got = read_ledger(spark, at, SCHEMA)
    assert got.count() == 40 and sorted(map(tuple, got.collect()))[0] == ("e0", 0, "计划", ["a"])
    broken = rows.withColumn("status", F.when(F.col("ord") == 17, F.raise_error(F.lit("broken"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("ledger").option("path", at).mode("append").save()
    assert read_ledger(spark, at, SCHEMA).count() == 40
    rows.limit(3).write.format("ledger").option("path", at).mode("append").save()
    assert read_ledger(spark, at, SCHEMA).count() == 43
    rows.limit(0).write.format("ledger").option("path", at).mode("append").save()
    assert read_ledger(spark, at, SCHEMA).count() == 43
    with pytest.raises(Exception, match="only grows"):
        rows.write.format("ledger").option("path", at).mode("overwrite").save()


def test_files_that_no_manifest_names_are_not_read(spark, tmp_path):
    spark.dataSource.register(LedgerSink)
    at = tmp_path / "ledger"
    spark.createDataFrame([("a", 1, "PLANNED", [])], SCHEMA).write.format("ledger").option("path", str(at)).mode("append").save()
    name = next((at / "data").glob("*.json"))
    (at / "data" / "retry.json").write_bytes(name.read_bytes())  # what a lost task had written
    (at / "manifests" / "_half.json").write_text('{"files": ["retry.json"]}')
    assert [tuple(r) for r in read_ledger(spark, str(at), SCHEMA).collect()] == [("a", 1, "PLANNED", [])]
