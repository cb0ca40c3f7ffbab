"""Audit registers: traces and their names, run costs, who produced what, provenance, view registers, node names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import spread


def trail_name(name: Column) -> Column:
    """struct<layer, actor, action> of a trail name: ``agent:who:what``, ``skill:who:what``, else a tool and its last part."""
    parts = F.split(name, ":")
    head = F.element_at(parts, 1)
    own = head.isin("agent", "skill") & (F.size(parts) >= 3)
    rest = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), ":")
    return F.struct(F.when(own, head).otherwise("tool").alias("layer"), F.when(own, F.get(parts, 1)).otherwise(head).alias("actor"), F.when(own, rest).otherwise(F.element_at(parts, -1)).alias("action"))


def span_events(events: DataFrame, most: int = 8) -> DataFrame:
    """trace_id, depth, status, duration_ms, warnings of spans from begin, end and warn rows (run, ord, kind, trace_id,
    text, ms): nesting by open spans, at most ``most`` warnings each, a span that never ends is running."""
    w = Window.partitionBy("run").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("kind") == "begin", 1).when(F.col("kind") == "end", -1).otherwise(0)
    e = events.withColumn("depth", F.sum(step).over(w))
    first = e.where("kind = 'begin'").select("run", "trace_id", "ord", F.col("depth").alias("depth"), F.col("ms").alias("_from"))
    last = e.where("kind = 'end'").select("run", "trace_id", F.col("ms").alias("_to"), F.coalesce("text", F.lit("ok")).alias("_status"))
    said = e.where("kind = 'warn'").withColumn("_k", F.row_number().over(Window.partitionBy("run", "trace_id").orderBy("ord"))).where(F.col("_k") <= most).groupBy("run", "trace_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "text"))), lambda x: F.left(x.text, F.lit(200))).alias("warnings"))
    out = first.join(last, ["run", "trace_id"], "left").join(said, ["run", "trace_id"], "left")
    return out.select("run", "trace_id", "ord", "depth", F.coalesce("_status", F.lit("running")).alias("status"), (F.col("_to") - F.col("_from")).alias("duration_ms"), F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"))


def trace_lines(events: DataFrame, members: DataFrame, fields: list[str]) -> DataFrame:
    """root, ord, line: a JSON line for each event of each subtree (root, id), in the order they happened."""
    rows = events.count()
    return spread(events, rows, "id").join(spread(members.select("root", "id"), rows, "id"), "id").select("root", "ord", F.to_json(F.struct(*fields)).alias("line"))


def run_costs(calls: DataFrame, by: list[str]) -> DataFrame:
    """by, calls, context_chars, context_items, warnings, latency: what a run's recorded calls (kind, chars, items, start,
    end) cost."""
    return calls.groupBy(*by).agg(
        F.count_if(F.col("kind") == "tool").alias("calls"), F.sum(F.when(F.col("kind") == "context", F.col("chars")).otherwise(0)).alias("context_chars"), F.sum(F.when(F.col("kind") == "context", F.col("items")).otherwise(0)).alias("context_items"),
        F.count_if(F.col("kind") == "warning").alias("warnings"), (F.max("end") - F.min("start")).alias("latency"),
    )


def produced(rows: DataFrame) -> DataFrame:
    """role, evidence_ids, finding_ids, decision_ids: what each role made, from rows (role, kind, id), in sorted lists."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("id")))).alias(f"{kind}_ids")
    return rows.groupBy("role").agg(of("evidence"), of("finding"), of("decision"))


def sources_of(provenance: DataFrame, entities: DataFrame) -> DataFrame:
    """id, n, first: how many sources are on record (id, source, ord) for some entities, and the earliest."""
    return provenance.join(entities.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n"), F.min_by("source", F.struct("ord", "source")).alias("first"))


def anchors(names: DataFrame, nodes: DataFrame) -> DataFrame:
    """name, id: a name as it is if it is a node, else under the first prefix (sym, scope, file) that makes it one, else as
    it is."""
    tries = F.array(F.col("name"), *[F.concat(F.lit(p), F.col("name")) for p in ("sym:", "scope:", "file:")])
    cand = names.select("name").distinct().select("name", F.posexplode(tries).alias("k", "id"))
    hit = cand.join(nodes.select("id").distinct(), "id", "left_semi").groupBy("name").agg(F.min_by("id", "k").alias("id"))
    return names.select("name").distinct().join(hit, "name", "left").select("name", F.coalesce("id", "name").alias("id"))


def file_of(node: Column) -> Column:
    """The file that a node's id names: of symbols before the last ``::``, of files and endpoints after the prefix, else null."""
    return F.when(F.startswith(node, F.lit("sym:")), F.regexp_replace(F.substring(node, F.lit(5), F.length(node)), "::[^:]*$", "")).when(F.startswith(node, F.lit("file:")), F.substring(node, F.lit(6), F.length(node))).when(F.startswith(node, F.lit("api:")), F.substring(node, F.lit(5), F.length(node)))


def file_history(commit_files: DataFrame, commits: DataFrame, files: DataFrame, most: int = 10) -> DataFrame:
    """file, k, sha: the commits (sha, ord) that touch some files, newest first, at most so many for each."""
    j = commit_files.select("sha", "file").distinct().join(files.select("file").distinct(), "file", "left_semi").join(commits.select("sha", "ord"), "sha")
    w = Window.partitionBy("file").orderBy(F.desc("ord"), F.desc("sha"))
    return j.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("file", "k", "sha")
