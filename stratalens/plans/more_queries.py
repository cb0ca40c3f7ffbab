"""Further single operators over the driver tables: tolerant matching, contracts, set operations, ranking, roles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.operators import codegraph, evidence, graph, lifecycle, metrics, policy, search, semantic

from .fact_queries import _FK, fk_edges, text
from .registry import query
from .search_queries import _LINES, doc_matches, table


@query("gold_tolerant", "WITH g AS (SELECT p_size AS k, p_brand || '::' || p_type AS gold FROM part), p AS (SELECT DISTINCT p_size AS k, p_type AS pred FROM part) SELECT DISTINCT k, gold FROM g WHERE EXISTS (SELECT 1 FROM p WHERE p.k = g.k AND (contains(gold, pred) OR contains(pred, gold)))")
def gold_tolerant(spark, d):
    part = table(spark, d, "part")
    gold = part.select(F.col("p_size").alias("k"), F.concat_ws("::", "p_brand", "p_type").alias("gold"))
    return metrics.tolerant_hits(gold, part.select(F.col("p_size").alias("k"), F.col("p_type").alias("pred")).distinct(), ["k"])


@query("plan_contract", "SELECT o_orderkey AS unit_id, f AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'f1::a' ELSE '' END AS s, CASE WHEN o_orderstatus = 'F' THEN 'REVERT' ELSE 'UNCHANGED' END AS contract FROM orders, (VALUES ('f1')) t(f) UNION ALL SELECT o_orderkey, 'f2', 'f2::b', CASE WHEN o_orderstatus = 'F' THEN 'REVERT' ELSE 'UNCHANGED' END FROM orders")
def plan_contract(spark, d):
    u = table(spark, d, "orders").select(F.col("o_orderkey").alias("unit_id"), F.when(F.col("o_orderstatus") == "F", "ROLLBACK").otherwise("KEEP").alias("action"), F.array(F.when(F.col("o_orderkey") % 2 == 0, "f1::a").otherwise("f3::a"), F.lit("f2::b")).alias("symbols"), F.array(F.lit("f1"), F.lit("f2")).alias("files"))
    return lifecycle.plan_contract(u).select("unit_id", "file", F.array_join("symbols", ",").alias("s"), "contract")


@query("lexical_impact", "WITH " + _LINES + r""" z AS (SELECT 1) SELECT role, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN regexp_matches(text, '\b(function|class|const|let|var|interface|type|enum)\s+that\b') THEN 'definition' WHEN regexp_matches(text, '\bthat\s*\(') THEN 'call' ELSE 'mention' END AS role FROM m) GROUP BY 1""")
def lexical_impact(spark, d):
    return codegraph.lexical_impact(doc_matches(spark, d), "that").groupBy("role").agg(F.count("*").alias("n"))


@query("hunk_index", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS INTEGER) AS idx FROM conversations")
def hunk_index(spark, d):
    w = Window.partitionBy("conv_id", "role").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", (F.row_number().over(w) - 1).alias("idx"))


@query("global_topk", "SELECT o_orderkey AS path, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def global_topk(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("score"), F.lit(0).alias("line_start"))
    return search.top_k(o, 10).select("path", "score")


_A, _B = "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A'", "SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R'"


@query("set_operations", f"SELECT 'union' AS op, k FROM ({_A} UNION {_B}) UNION ALL SELECT 'intersect', k FROM ({_A} INTERSECT {_B}) UNION ALL SELECT 'except', k FROM ({_A} EXCEPT {_B})")
def set_operations(spark, d):
    li = table(spark, d, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")) for x in "AR")
    tag = lambda name, df: df.select(F.lit(name).alias("op"), "k")
    return tag("union", a.union(b).distinct()).union(tag("intersect", a.intersect(b))).union(tag("except", a.subtract(b)))


@query("multiset_difference", f"{_A} EXCEPT ALL {_B}")
def multiset_difference(spark, d):
    li = table(spark, d, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == x).select(F.col("l_partkey").alias("k")) for x in "AR")
    return a.exceptAll(b)


@query("endpoint_roles", """WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'src/app/x' || page_id || '/route.ts' WHEN 1 THEN 'app/route.ts' WHEN 2 THEN 'app/y/page.tsx' ELSE 'lib/route.ts' END AS path FROM pages)
SELECT DISTINCT path AS file, CASE page_id % 4 WHEN 0 THEN '/x' || page_id ELSE '/' END AS route_path FROM p WHERE page_id % 4 < 2""")
def endpoint_roles(spark, d):
    k = F.col("page_id")
    path = F.when(k % 4 == 0, F.concat(F.lit("src/app/x"), text("page_id"), F.lit("/route.ts"))).when(k % 4 == 1, "app/route.ts").when(k % 4 == 2, "app/y/page.tsx").otherwise("lib/route.ts")
    symbols = spark.range(0).select(F.lit("").alias("name"), F.lit("").alias("file"))
    return codegraph.api_endpoints(symbols, table(spark, d, "pages").select(path.alias("path")).distinct()).select("file", "route_path")


@query("importers", "SELECT DISTINCT 's' || l_suppkey AS source_file, 'p' || l_partkey || CASE WHEN l_partkey % 10 = 0 THEN '.test.ts' ELSE '.ts' END AS importer FROM lineitem WHERE l_partkey % 10 = 0 AND l_suppkey % 4 <> 0")
def importers(spark, d):
    i = table(spark, d, "lineitem").select(F.when(F.col("l_suppkey") % 4 == 0, "").otherwise(F.concat(F.lit("s"), text("l_suppkey"))).alias("source_file"), F.concat(F.lit("p"), text("l_partkey"), F.when(F.col("l_partkey") % 10 == 0, ".test.ts").otherwise(".ts")).alias("importer"))
    return codegraph.importers(i, tests_only=True)


@query("precedents", "SELECT item_id FROM benchmark WHERE item_id % 2 = 0 AND (contains(CAST(item_id AS VARCHAR), '12') OR regexp_matches(text, '(^|[^A-Za-z0-9_])(that|whed)([^A-Za-z0-9_]|$)'))")
def precedents(spark, d):
    rows = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("category"), text("item_id").alias("target"), F.col("text").alias("statement"))
    return evidence.precedents(rows, "even", "12", "that whed").select("item_id")


@query("command_guard", "SELECT DISTINCT event_type, event_type IN ('click', 'view') AS allowed FROM events")
def command_guard(spark, d):
    return table(spark, d, "events").select("event_type", policy.allowed_command(F.array(F.concat(F.lit("/usr/bin/"), F.col("event_type")), F.lit("-q")), ["click", "view"]).alias("allowed")).distinct()


@query("single_rule", "SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'")
def single_rule(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.array(F.when(F.col("o_orderpriority").like("1%"), "/r").otherwise("")).alias("affected_routes"))
    return policy.single_rule(o, "rollback_public_api").select("o_orderkey")


@query("expected_face", "WITH a AS (SELECT l_orderkey AS sha, l_partkey % 5 AS t, count(*) AS want FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2), g AS (SELECT l_orderkey AS sha, l_suppkey % 5 AS t, count(*) AS got FROM lineitem GROUP BY 1, 2) SELECT sha, bool_and(coalesce(got, 0) >= want) AS expected FROM a LEFT JOIN g USING (sha, t) GROUP BY 1")
def expected_face(spark, d):
    li = table(spark, d, "lineitem")
    line = lambda tag, c: F.array(F.struct(F.lit(tag).alias("tag"), (F.col(c) % 5).cast("string").alias("text"))).alias("lines")
    rb = li.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("sha"), F.lit("f").alias("file"), line("+", "l_partkey"))
    return lifecycle.expected_face(rb, li.select(F.col("l_orderkey").alias("sha"), F.lit("f").alias("file"), line("-", "l_suppkey")))


@query("related_symbols", "SELECT 's' || s_suppkey AS feature, 'n' || s_nationkey AS symbol FROM supplier")
def related_symbols(spark, d):
    return semantic.related_symbols(fk_edges(spark, d).withColumn("type", F.when(F.col("type") == "SITS", "IMPLEMENTS").otherwise(F.col("type"))))


@query("layer_ladder", "SELECT * FROM (VALUES ('G0', 1), ('G1', 2), ('G2', 3), ('G3', 3), ('G4', 3)) t(level, layers)")
def layer_ladder(spark, d):
    nodes = fk_edges(spark, d).select(F.when(F.col("type") == "IN", "code").when(F.col("type") == "BY", "change").otherwise("semantic").alias("layer")).distinct()
    rows = [nodes.where(F.col("layer").isin(v)).agg(F.count("*").cast("int").alias("layers")).select(F.lit(k).alias("level"), "layers") for k, v in fixed.LAYERS.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("view_dump", f"WITH {_FK}, l AS (SELECT DISTINCT src || ' -' || type || '-> ' || dst AS line FROM e WHERE src = 'n1' OR dst = 'n1') SELECT 'n1' AS task_id, sha256(left(string_agg(line, chr(10) ORDER BY line), 4000)) AS digest FROM l")
def view_dump(spark, d):
    targets = spark.range(1).select(F.lit("n1").alias("task_id"), F.lit("n1").alias("target"))
    nodes = fk_edges(spark, d).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.dump_view(graph.task_view(nodes, fk_edges(spark, d), targets)[1]).select("task_id", F.sha2("text", 256).alias("digest"))
