"""Where results go: JSON, graph folders, append-only logs, patches, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, pretty: bool = True) -> None:
    """One JSON text a row."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": str(pretty).lower()}).alias("value")).write.mode("overwrite").text(path, lineSep="\n")


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Parquet by layer, so a layer is pruned where it is read."""
    nodes.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("layer").parquet(f"{path}/edges")


def write_adjacency(edges: DataFrame, name: str, path: str, buckets: int = 200) -> DataFrame:
    """The table ``name`` at ``path``: u, v, type, layer, forward, each edge once from either end, by layer, and within it in
    buckets by u, sorted.

    Joins on u need no shuffle of the edges, and other layers aren't read. One task writes a bucket of each layer, so
    there are as many files as buckets and layers.
    """
    ahead = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "type", "layer", F.lit(True).alias("forward"))
    back = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "type", "layer", F.lit(False).alias("forward"))
    both = ahead.unionByName(back).repartition(buckets, "u")
    both.write.mode("overwrite").partitionBy("layer").bucketBy(buckets, "u").sortBy("u").option("path", path).saveAsTable(name)
    return edges.sparkSession.table(name)


def append_log(df: DataFrame, path: str) -> None:
    """Attempts, transitions and events only ever grow; the latest state is a query."""
    df.write.mode("append").parquet(path)


def write_patches(patches: DataFrame, path: str, role: str) -> None:
    """proposed, actual, verified or reverse patch texts with their SHA-256."""
    patches.withColumn("role", F.lit(role)).write.mode("append").partitionBy("role").parquet(path)


def report(summary: DataFrame, title: str) -> str:
    """A Markdown table of a summary, a few rows for each kind of task."""
    rows = summary.collect()  # a summary: as many rows as there are kinds of tasks
    head = "| " + " | ".join(summary.columns) + " |\n|" + "---|" * len(summary.columns)
    return f"# {title}\n\n{head}\n" + "\n".join("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows) + "\n"
