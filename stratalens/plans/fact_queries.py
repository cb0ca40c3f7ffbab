"""Facts, graphs, rules and metrics over the driver tables.

Orders stand for commits, parts for files, line numbers for hunks, suppliers for symbols, users for attempts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed
from stratalens.operators import cochange, codegraph, evidence, graph, lifecycle, metrics, policy, ranges, units
from stratalens.operators.components import connected_components
from stratalens.operators.scratch import dealt, spread, written

from .registry import query
from .search_queries import table


def text(c: str) -> Column:
    return F.col(c).cast("string")


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file"))


def pairs(spark: SparkSession, d: str, support: int) -> DataFrame:
    return cochange.cochange_pairs(commit_files(spark, d), support=support)


_CF = "cf AS (SELECT DISTINCT l_orderkey AS sha, l_partkey AS file FROM lineitem)"
_PAIRS = _CF + ", p AS (SELECT a.file AS a, b.file AS b, count(*) AS n FROM cf a JOIN cf b ON a.sha = b.sha AND a.file < b.file GROUP BY 1, 2)"


@query("cochange_pairs", f"WITH {_PAIRS} SELECT a, b, CAST(n AS BIGINT) AS n FROM p WHERE n >= 2")
def cochange_pairs(spark, d):
    return pairs(spark, d, 2)


@query("cochange_top5", f"WITH {_PAIRS}, q AS (SELECT a AS file, b AS partner, n FROM p WHERE n >= 2 UNION ALL SELECT b, a, n FROM p WHERE n >= 2) SELECT file, partner, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n DESC, partner) AS r FROM q) WHERE r <= 5")
def cochange_top5(spark, d):
    return cochange.partners(pairs(spark, d, 2), 5)


@query("commit_votes", f"WITH {_CF}, v AS (SELECT o_orderkey AS sha, o_orderdate AS o FROM orders WHERE contains(lower(o_orderpriority), 'urgent') OR contains(lower(o_orderpriority), 'high')) SELECT file, CAST(count(*) AS BIGINT) AS votes, array_to_string((list(sha ORDER BY o, sha))[1:3], ',') AS firsts, 4.0::DOUBLE + 0.5 * (count(*) - 1) AS boost FROM cf JOIN v USING (sha) GROUP BY 1")
def commit_votes(spark, d):
    commits = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderpriority").alias("message"), F.col("o_orderdate").alias("ord"))
    v = cochange.commit_votes(commits, commit_files(spark, d), ["URGENT", "HIGH"])
    return v.select("file", "votes", F.array_join(F.transform("first_commits", lambda x: x.cast("string")), ",").alias("firsts"), "boost")


@query("cochange_boost", f"WITH {_PAIRS}, v AS (SELECT p_partkey AS k FROM part WHERE p_size <= 5), q AS (SELECT a AS file, b AS o FROM p WHERE n >= 2 UNION SELECT b, a FROM p WHERE n >= 2) SELECT file, 1.5::DOUBLE AS boost FROM (SELECT p_partkey AS file FROM part WHERE p_size > 5) c WHERE EXISTS (SELECT 1 FROM q JOIN v ON q.o = v.k WHERE q.file = c.file)")
def cochange_boost(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("file"), "p_size")
    return cochange.cochange_boost(part.where("p_size > 5").select("file"), pairs(spark, d, 2), part.where("p_size <= 5").select("file"))


# --- range joins

_SYMS = """
q AS (SELECT l_orderkey AS file, l_linenumber AS ln, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS e, CAST(l_quantity AS BIGINT) AS q FROM lineitem),
s AS (SELECT file, 'l' || ln AS qualified, e - q + 1 AS a, e AS z, ln AS ord FROM q UNION ALL SELECT file, 'all', 1, max(e), 0 FROM q GROUP BY file),
"""


def order_symbols(spark, d) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("ord"), F.col("l_quantity").cast("bigint").alias("q"))
    li = spread(li, li.count(), "file")
    w = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    own = li.withColumn("line_end", F.sum("q").over(w)).select("file", F.concat(F.lit("l"), text("ord")).alias("qualified"), (F.col("line_end") - F.col("q") + 1).alias("line_start"), "line_end", "ord")
    whole = own.groupBy("file").agg(F.lit("all").alias("qualified"), F.lit(1).cast("bigint").alias("line_start"), F.max("line_end").alias("line_end"), F.lit(0).alias("ord"))
    return own.unionByName(whole)


@query("symbol_at", "WITH " + _SYMS + " p AS (SELECT l_orderkey AS file, l_linenumber AS k, l_partkey % 60 + 1 AS line FROM lineitem) SELECT file, k, line, qualified FROM (SELECT p.file, p.k, p.line, s.qualified, row_number() OVER (PARTITION BY p.file, p.k, p.line ORDER BY z - a, ord) AS r FROM p JOIN s ON s.file = p.file AND p.line BETWEEN s.a AND s.z) WHERE r = 1")
def symbol_at(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 60 + 1).alias("line"))
    return ranges.innermost(points, order_symbols(spark, d), ["file"], "line", "line_start", "line_end", ["ord"], ["file", "k", "line"]).select("file", "k", "line", "qualified")


@query("symbol_at_bucketed", "WITH " + _SYMS + " p AS (SELECT l_orderkey AS file, l_linenumber AS k, l_partkey % 60 + 1 AS line FROM lineitem) SELECT qualified, CAST(count(*) AS BIGINT) AS n FROM p JOIN s ON s.file = p.file AND p.line BETWEEN s.a AND s.z GROUP BY 1")
def symbol_at_bucketed(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("k"), (F.col("l_partkey") % 60 + 1).alias("line"))
    return ranges.containing(points, order_symbols(spark, d), ["file"], "line", "line_start", "line_end", bucket=64).groupBy("qualified").agg(F.count("*").alias("n"))


@query("hunk_symbols", "WITH " + _SYMS + " h AS (SELECT l_orderkey AS file, l_linenumber AS idx, unnest(range(l_linenumber * 5, l_linenumber * 5 + greatest(CAST(l_quantity AS BIGINT) % 8, 1))) AS line FROM lineitem), r AS (SELECT h.file, h.idx, s.qualified, row_number() OVER (PARTITION BY h.file, h.idx, h.line ORDER BY z - a, ord) AS r FROM h JOIN s ON s.file = h.file AND h.line BETWEEN s.a AND s.z) SELECT file, idx, array_to_string(list_sort(list(DISTINCT qualified)), ',') AS symbols FROM r WHERE r = 1 GROUP BY 1, 2")
def hunk_symbols(spark, d):
    hunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("idx"), (F.col("l_linenumber").cast("bigint") * 5).alias("new_start"), (F.col("l_quantity").cast("bigint") % 8).alias("new_lines"))
    return ranges.hunk_symbols(hunks, order_symbols(spark, d), ["sha", "idx"]).select(F.col("sha").alias("file"), "idx", F.array_join("symbols", ",").alias("symbols"))


# --- code graph joins

_CALLS = """
sy AS (SELECT 's' || s_suppkey AS qualified, 'n' || (s_suppkey % 61) AS name, 'f' || s_nationkey AS file FROM supplier),
ca AS (SELECT 'o' || l_orderkey AS caller, 'f' || (l_orderkey % 25) AS caller_file, 'n' || (l_suppkey % 61) AS short, l_linenumber AS line FROM lineitem),
im AS (SELECT DISTINCT 'f' || n_nationkey AS importer, 'n' || unnest([n_nationkey, n_nationkey + 7]) AS name FROM nation),
un AS (SELECT name, count(*) AS k FROM sy GROUP BY 1),
cs AS (SELECT sy.qualified, ca.caller, ca.caller_file, ca.line FROM ca JOIN sy ON ca.short = sy.name JOIN un ON un.name = sy.name WHERE ca.caller_file = sy.file OR un.k = 1 OR EXISTS (SELECT 1 FROM im WHERE im.importer = ca.caller_file AND im.name = sy.name)),
"""


def code_facts(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    sup = table(spark, d, "supplier")
    name = F.concat(F.lit("n"), (F.col("s_suppkey") % 61).cast("string"))
    symbols = sup.select(F.concat(F.lit("s"), text("s_suppkey")).alias("qualified"), name.alias("name"), F.concat(F.lit("f"), text("s_nationkey")).alias("file"), F.when(F.col("s_suppkey") % 2 == 0, "component").otherwise("function").alias("kind"))
    li = table(spark, d, "lineitem")
    calls = li.select(F.concat(F.lit("o"), text("l_orderkey")).alias("caller"), F.concat(F.lit("f"), (F.col("l_orderkey") % 25).cast("string")).alias("caller_file"), F.concat(F.lit("n"), (F.col("l_suppkey") % 61).cast("string")).alias("callee_short"), F.col("l_linenumber").alias("line"))
    names = F.array(*[F.concat(F.lit("n"), (F.col("n_nationkey") + k).cast("string")) for k in (0, 7)])
    imports = table(spark, d, "nation").select(F.concat(F.lit("f"), text("n_nationkey")).alias("importer"), names.alias("names"))
    return calls, symbols, imports


@query("callers_3tier", "WITH " + _CALLS + " z AS (SELECT 1) SELECT qualified, caller_file, CAST(count(*) AS BIGINT) AS n, CAST(sum(line) AS BIGINT) AS lines FROM cs GROUP BY 1, 2")
def callers_3tier(spark, d):
    return codegraph.caller_counts(*code_facts(spark, d)).groupBy("qualified", "caller_file").agg(F.sum("n").alias("n"), F.sum("lines").alias("lines"))


@query("jsx_callers", "WITH " + _CALLS + " j AS (SELECT 'f' || (o_orderkey % 25) AS file, 'n' || (o_custkey % 61) AS name, CAST(o_orderkey AS BIGINT) AS line FROM orders) SELECT sy.qualified, j.file, CAST(count(*) AS BIGINT) AS n FROM j JOIN sy ON j.name = sy.name JOIN un ON un.name = sy.name JOIN supplier ON 's' || s_suppkey = sy.qualified WHERE s_suppkey % 2 = 0 AND j.file <> sy.file AND (un.k = 1 OR EXISTS (SELECT 1 FROM im WHERE im.importer = j.file AND im.name = sy.name)) GROUP BY 1, 2")
def jsx_callers(spark, d):
    _, symbols, imports = code_facts(spark, d)
    refs = table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 25).cast("string")).alias("file"), F.concat(F.lit("n"), (F.col("o_custkey") % 61).cast("string")).alias("component"), F.col("o_orderkey").alias("line"))
    return codegraph.jsx_counts(refs, symbols, imports).groupBy("qualified", "file").agg(F.sum("n").alias("n"))


@query("callees_prefix", "SELECT l_shipdate, l_orderkey FROM (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS l_shipdate, CASE WHEN l_partkey % 3 = 0 THEN 'f::a' WHEN l_partkey % 3 = 1 THEN 'f::a.b' ELSE 'f::ab' END AS caller FROM lineitem) WHERE caller = 'f::a' OR starts_with(caller, 'f::a.')")
def callees_prefix(spark, d):
    caller = F.when(F.col("l_partkey") % 3 == 0, "f::a").when(F.col("l_partkey") % 3 == 1, "f::a.b").otherwise("f::ab")
    return codegraph.callees(table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("l_shipdate"), caller.alias("caller")), "f::a").select("l_shipdate", "l_orderkey")


@query("import_priority", """WITH f AS (SELECT 'src/p' || p_partkey || CASE p_size % 4 WHEN 0 THEN '.ts' WHEN 1 THEN '.tsx' WHEN 2 THEN '/index.ts' ELSE '.css' END AS path FROM part UNION SELECT 'src/p' || p_partkey || '.js' FROM part WHERE p_partkey % 5 = 0),
i AS (SELECT DISTINCT 'src/o' || l_orderkey || '.ts' AS importer, './p' || l_partkey AS specifier, 'src/p' || l_partkey AS base FROM lineitem),
s(ord, sfx) AS (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (4, '.jsx'), (5, '/index.ts'), (6, '/index.tsx'))
SELECT importer, specifier, coalesce(arg_min(f.path, s.ord), '') AS source_file FROM i CROSS JOIN s LEFT JOIN f ON f.path = i.base || s.sfx GROUP BY 1, 2""")
def import_priority(spark, d):
    part = table(spark, d, "part")
    base = F.concat(F.lit("src/p"), text("p_partkey"))
    kinds = F.element_at(F.array(*[F.lit(x) for x in (".ts", ".tsx", "/index.ts", ".css")]), (F.col("p_size") % 4 + 1).cast("int"))
    files = part.select(F.concat(base, kinds).alias("path")).union(part.where("p_partkey % 5 = 0").select(F.concat(base, F.lit(".js"))))
    li = table(spark, d, "lineitem")
    once = dealt(li.select("l_orderkey", "l_partkey"), li.count(), "l_orderkey").distinct()
    imports = written(once.select(F.concat(F.lit("src/o"), text("l_orderkey"), F.lit(".ts")).alias("importer"), F.concat(F.lit("./p"), text("l_partkey")).alias("specifier")), "imports")
    return codegraph.resolve_imports(imports, files).select("importer", "specifier", "source_file")


@query("coupling", f"WITH {_PAIRS}, x AS (SELECT a AS src, b AS dst FROM p WHERE n >= 2), a AS (SELECT p_partkey AS k FROM part WHERE p_size <= 20), b AS (SELECT p_partkey AS k FROM part WHERE p_size > 20) SELECT src, dst FROM x WHERE src IN (SELECT k FROM a) AND dst IN (SELECT k FROM b) UNION SELECT src, dst FROM x WHERE src IN (SELECT k FROM b) AND dst IN (SELECT k FROM a)")
def coupling(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("node"), "p_size")
    e = pairs(spark, d, 2).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return codegraph.couplings(e, part.where("p_size <= 20"), part.where("p_size > 20"))


# --- audit

@query("unsupported", "SELECT DISTINCT l_orderkey AS finding_id FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 45)")
def unsupported(spark, d):
    findings = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.collect_list("l_partkey").alias("evidence_ids"))
    return evidence.unsupported(findings, table(spark, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("id")))


_TYPES = ["AST", "LEXICAL", "SEMANTIC_MAPPING", "EXECUTION_PLAN", "TEST", "PROMOTION"]
_TYPE_SQL = "CASE p_partkey % 6 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_TYPES)) + " END"


@query("verdicts", f"""WITH e AS (SELECT p_partkey AS id, {_TYPE_SQL} AS type FROM part WHERE p_size <= 45),
c AS (SELECT l_orderkey AS f, count(*) AS n, count(*) FILTER (e.id IS NULL) AS missing, count(*) FILTER (type IN ('AST', 'TEST')) AS det, count(*) FILTER (type IN ('LEXICAL', 'SEMANTIC_MAPPING')) AS sem FROM lineitem LEFT JOIN e ON e.id = l_partkey GROUP BY 1)
SELECT f AS finding_id, CASE WHEN missing = 0 AND det > 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS deterministic, CASE WHEN sem > 0 THEN CASE WHEN det > 0 THEN 'SUPPORTED' ELSE 'PARTIALLY_SUPPORTED' END END AS semantic, CASE WHEN missing = 0 AND det > 0 THEN 'verified' ELSE 'unsupported' END AS status FROM c""")
def verdicts(spark, d):
    findings = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.collect_list("l_partkey").alias("evidence_ids"))
    kind = F.element_at(F.array(*[F.lit(t) for t in _TYPES]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return evidence.verdicts(findings, table(spark, d, "part").where("p_size <= 45").select(F.col("p_partkey").alias("id"), kind.alias("type")))


@query("evidence_register", "SELECT o_orderstatus AS type, o_orderpriority AS target, arg_min(o_orderkey, o_orderkey) AS first_key FROM orders GROUP BY 1, 2")
def evidence_register(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("type"), F.col("o_orderpriority").alias("target"), F.lit("").alias("location"), F.col("o_orderkey").alias("ord"))
    return evidence.register_evidence(rows).select("type", "target", F.col("ord").alias("first_key"))


@query("evidence_filter", "SELECT event_id, ts FROM events WHERE user_id = 7 AND event_type = 'click'")
def evidence_filter(spark, d):
    ev = table(spark, d, "events").select(F.col("event_id").alias("id"), text("user_id").alias("target"), F.col("event_type").alias("type"), F.col("ts").alias("timestamp"))
    return evidence.evidence_of(ev, "7", "click").select(F.col("id").alias("event_id"), F.col("timestamp").alias("ts"))


@query("conflict_resolution", f"WITH {_PAIRS}, c AS (SELECT a, b, CASE WHEN (a + b) % 3 = 0 THEN a WHEN (a + b) % 3 = 1 THEN b END AS w FROM p WHERE n >= 3) SELECT CASE WHEN w = a THEN b ELSE a END AS finding_id, 'contradicted' AS status, CAST(a * 100000 + b AS BIGINT) AS decision_id FROM c WHERE w IS NOT NULL")
def conflict_resolution(spark, d):
    c = pairs(spark, d, 3).select("a", "b")
    m = (F.col("a") + F.col("b")) % 3
    return evidence.resolve_conflicts(c, c.select("a", "b", F.when(m == 0, F.col("a")).when(m == 1, F.col("b")).alias("winner"), (F.col("a") * 100000 + F.col("b")).alias("decision_id")))


@query("arbitrate", """WITH p AS (SELECT o_orderkey AS u, o_orderstatus AS c, round(o_totalprice) AS s FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'),
k AS (SELECT o_orderkey AS u, o_orderstatus AS c, CAST(o_custkey * 200 AS DOUBLE) AS s FROM orders WHERE o_orderstatus = 'F'),
j AS (SELECT coalesce(k.u, p.u) AS u, coalesce(k.c, p.c) AS c, k.s IS NOT NULL AND (p.s IS NULL OR k.s > p.s) AS keep, CASE WHEN k.s IS NOT NULL AND (p.s IS NULL OR k.s > p.s) THEN k.s ELSE p.s END AS s FROM p FULL JOIN k ON p.u = k.u),
pins AS (SELECT DISTINCT c FROM j WHERE keep AND c <> '')
SELECT u AS unit_id, c AS commit, CASE WHEN keep THEN 'keep' ELSE 'problem' END AS side, s AS score FROM j WHERE keep OR NOT EXISTS (SELECT 1 FROM pins) OR c IN (SELECT c FROM pins)""")
def arbitrate(spark, d):
    o = table(spark, d, "orders")
    p = o.where("o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderstatus").alias("commit"), F.round("o_totalprice").alias("score"))
    k = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("unit_id"), F.col("o_orderstatus").alias("commit"), (F.col("o_custkey") * 200).cast("double").alias("score"))
    return units.arbitrate(p, k)


def _versions(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(text("doc_id").alias("path"), "doc_id", "text")
    e = docs.where("doc_id % 7 <> 0").select("path", F.md5("text").alias("hash"))
    a = docs.where("doc_id % 5 <> 0").select("path", F.md5(F.concat("text", F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""))).alias("hash"))
    return e, a


_VERSIONS = "e AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(text) AS h FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT CAST(doc_id AS VARCHAR) AS path, md5(text || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 5 <> 0), j AS (SELECT coalesce(e.path, a.path) AS path, e.h AS e, a.h AS a FROM e FULL JOIN a ON e.path = a.path)"


@query("snapshot_diff", f"WITH {_VERSIONS} SELECT * FROM (SELECT path, CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'new' WHEN e <> a THEN 'changed' END AS problem FROM j) WHERE problem IS NOT NULL")
def snapshot_diff(spark, d):
    return lifecycle.snapshot_diff(*_versions(spark, d))


@query("content_drift", f"WITH {_VERSIONS} SELECT * FROM (SELECT path, CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL AND CAST(path AS BIGINT) % 14 <> 0 THEN 'outside plan' WHEN e <> a THEN 'differs from plan' END AS problem FROM j WHERE CAST(path AS BIGINT) % 2 = 0) WHERE problem IS NOT NULL")
def content_drift(spark, d):
    docs = table(spark, d, "documents")
    return lifecycle.content_drift(*_versions(spark, d), docs.where("doc_id % 2 = 0").select(text("doc_id").alias("path")), docs.where("doc_id % 14 = 0").select(text("doc_id").alias("path")))


# --- components and units

@query("components", f"WITH RECURSIVE {_PAIRS}, e AS MATERIALIZED (SELECT a, b FROM p WHERE n >= 3 UNION ALL SELECT b, a FROM p WHERE n >= 3), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS node, least(a, min(b)) AS component FROM r GROUP BY a")
def components(spark, d):
    return connected_components(pairs(spark, d, 3), "a", "b")


@query("unit_collect", "SELECT l_orderkey AS sha, array_to_string(list_sort(list(DISTINCT l_partkey)), ',') AS files, round(count(*) / count(DISTINCT l_suppkey), 2) AS cohesion FROM lineitem GROUP BY 1")
def unit_collect(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("sha"))
    return g.agg(F.array_join(F.transform(F.array_sort(F.collect_set("l_partkey")), lambda x: x.cast("string")), ",").alias("files"), F.round(F.count("*") / F.count_distinct("l_suppkey"), 2).alias("cohesion"))


@query("unit_score", """WITH t(t) AS (VALUES ('promo'), ('tin'), ('brand#1'), ('steel')) SELECT p_partkey, round(sum(CASE WHEN lower(p_brand) = t THEN 3.0::DOUBLE WHEN contains(lower(p_brand), t) THEN 2.1 ELSE 0 END + CASE WHEN contains(lower(p_type), t) THEN 2 ELSE 0 END + CASE WHEN contains(lower(p_name), t) THEN 2 ELSE 0 END + CASE WHEN contains(lower(p_type), t) THEN 1 ELSE 0 END), 4) AS score FROM part, t GROUP BY 1 HAVING sum(CASE WHEN contains(lower(p_brand), t) OR contains(lower(p_type), t) OR contains(lower(p_name), t) THEN 1 ELSE 0 END) > 0""")
def unit_score(spark, d):
    u = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("label"), F.array("p_type").alias("ui_strings"), F.array("p_name").alias("symbols"), F.array("p_type").alias("files"))
    return units.unit_scores(u, ["promo", "tin", "brand#1", "steel"]).select("p_partkey", "score")


@query("unit_filter", "SELECT p_partkey FROM part WHERE p_brand = 'Brand#11' AND contains(p_name, 'a')")
def unit_filter(spark, d):
    u = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("label"), F.array("p_name").alias("files"))
    return u.where((F.col("label") == "Brand#11") & F.exists("files", lambda f: F.contains(f, F.lit("a")))).select("p_partkey")


@query("collateral_risk", """WITH x AS (SELECT DISTINCT l_orderkey AS sha, l_suppkey AS file, CASE WHEN l_returnflag = 'R' THEN 'ROLLBACK' ELSE 'KEEP' END AS a FROM lineitem),
s AS (SELECT sha, string_agg(CAST(file AS VARCHAR), ',' ORDER BY CAST(file AS VARCHAR)) AS shared FROM (SELECT sha, file FROM x GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 1), b AS (SELECT sha, count(*) FILTER (a = 'ROLLBACK') AS n FROM x GROUP BY 1)
SELECT sha, round(least(1.0::DOUBLE, CASE WHEN shared IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN n = 0 THEN 0.2::DOUBLE ELSE 0 END), 3) AS risk, coalesce(shared, '') AS shared FROM b LEFT JOIN s USING (sha)""")
def collateral_risk(spark, d):
    u = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.array(text("l_suppkey")).alias("files"), F.when(F.col("l_returnflag") == "R", "ROLLBACK").otherwise("KEEP").alias("action"))
    return units.collateral_risk(u).select("sha", "risk", F.array_join("shared_files", ",").alias("shared"))


# --- graph

def fk_edges(spark, d) -> DataFrame:
    def e(name, a, pa, b, pb, kind):
        return table(spark, d, name).select(F.concat(F.lit(pa), text(a)).alias("src"), F.concat(F.lit(pb), text(b)).alias("dst"), F.lit(kind).alias("type"))

    return e("nation", "n_nationkey", "n", "n_regionkey", "r", "IN").unionByName(e("customer", "c_custkey", "c", "c_nationkey", "n", "LIVES")).unionByName(e("supplier", "s_suppkey", "s", "s_nationkey", "n", "SITS")).unionByName(e("orders", "o_orderkey", "o", "o_custkey", "c", "BY"))


_FK = "e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst, 'IN' AS type FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'LIVES' FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'SITS' FROM supplier UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey, 'BY' FROM orders)"


@query("edge_fold", "SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst, l_returnflag AS type, CAST(count(*) AS BIGINT) AS cnt, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS status FROM lineitem GROUP BY 1, 2, 3")
def edge_fold(spark, d):
    raw = table(spark, d, "lineitem").select(F.concat(F.lit("s"), text("l_suppkey")).alias("src"), F.concat(F.lit("p"), text("l_partkey")).alias("dst"), F.col("l_returnflag").alias("type"), F.lit("").alias("salt"), F.lit("code").alias("layer"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.create_map(F.lit("status"), F.col("l_linestatus")).alias("props"))
    return graph.fold_edges(raw, ["status"]).select("src", "dst", "type", "cnt", F.col("props")["status"].alias("status"))


@query("node_fold", "SELECT 's' || l_suppkey AS id, arg_min(l_linestatus, l_orderkey * 10 + l_linenumber) AS status, count(DISTINCT l_linestatus) > 1 AS conflict FROM lineitem GROUP BY 1")
def node_fold(spark, d):
    raw = table(spark, d, "lineitem").select(F.concat(F.lit("s"), text("l_suppkey")).alias("id"), F.lit("Symbol").alias("type"), F.lit("code").alias("layer"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.create_map(F.lit("status"), F.col("l_linestatus")).alias("props"))
    return graph.fold_nodes(raw).select("id", F.col("props")["status"].alias("status"), (F.size("conflicts") > 0).alias("conflict"))


def layered(spark, d) -> tuple[DataFrame, DataFrame]:
    layer = F.when(F.left("id", F.lit(1)).isin("r", "n"), "code").when(F.left("id", F.lit(1)) == "c", "semantic").otherwise("change")
    e = fk_edges(spark, d)
    nodes = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct().withColumn("layer", layer)
    return nodes, e.withColumn("layer", F.when(F.col("type") == "IN", "code").when(F.col("type") == "BY", "change").otherwise("semantic"))


_LAYER = _FK + ", nd AS (SELECT id, CASE WHEN left(id, 1) IN ('r', 'n') THEN 'code' WHEN left(id, 1) = 'c' THEN 'semantic' ELSE 'change' END AS layer FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)), le AS (SELECT *, CASE type WHEN 'IN' THEN 'code' WHEN 'BY' THEN 'change' ELSE 'semantic' END AS layer FROM e)"


@query("layer_stats", f"WITH {_LAYER} SELECT coalesce(a.layer, b.layer) AS layer, CAST(coalesce(nodes, 0) AS BIGINT) AS nodes, CAST(coalesce(edges, 0) AS BIGINT) AS edges FROM (SELECT layer, count(*) AS nodes FROM nd GROUP BY 1) a FULL JOIN (SELECT layer, count(*) AS edges FROM le GROUP BY 1) b USING (layer)")
def layer_stats(spark, d):
    return graph.layer_stats(*layered(spark, d))


@query("layer_prune", f"WITH {_LAYER} SELECT src, dst, type FROM le WHERE layer IN ('code', 'semantic') AND EXISTS (SELECT 1 FROM nd WHERE id = src AND layer IN ('code', 'semantic')) AND EXISTS (SELECT 1 FROM nd WHERE id = dst AND layer IN ('code', 'semantic'))")
def layer_prune(spark, d):
    return graph.prune_layers(*layered(spark, d), ["code", "semantic"])[1].select("src", "dst", "type")


@query("type_selection", f"WITH {_FK} SELECT src, dst FROM e WHERE type IN ('IN', 'SITS')")
def type_selection(spark, d):
    return fk_edges(spark, d).where(F.col("type").isin("IN", "SITS")).select("src", "dst")


@query("bfs_depth2", f"WITH {_FK}, u AS (SELECT src AS u, dst AS v FROM e UNION SELECT dst, src FROM e), a AS (SELECT 'r1' AS start, v AS id FROM u WHERE u = 'r1'), b AS (SELECT DISTINCT 'r1' AS start, v AS id FROM a JOIN u ON u.u = a.id WHERE v <> 'r1' AND v NOT IN (SELECT id FROM a)) SELECT start, id, 1 AS depth FROM a UNION ALL SELECT start, id, 2 FROM b")
def bfs_depth2(spark, d):
    return graph.neighbours(fk_edges(spark, d), spark.range(1).select(F.lit("r1").alias("start")), 2, direction="both")


@query("shortest_path_len", f"WITH RECURSIVE {_FK}, u AS MATERIALIZED (SELECT src AS u, dst AS v FROM e WHERE type <> 'BY' UNION SELECT dst, src FROM e WHERE type <> 'BY'), w(id, n) AS (SELECT 's1', 0 UNION SELECT v, n + 1 FROM w JOIN u ON u.u = w.id WHERE n < 6), m AS (SELECT id, min(n) AS n FROM w GROUP BY 1) SELECT 's1' AS start, id AS \"end\", CAST(n AS INTEGER) AS hops FROM m WHERE left(id, 1) = 's' AND id <> 's1'")
def shortest_path_len(spark, d):
    ends = table(spark, d, "supplier").where("s_suppkey <> 1").select(F.lit("s1").alias("start"), F.concat(F.lit("s"), text("s_suppkey")).alias("end"))
    return graph.shortest_paths(fk_edges(spark, d), ends, 6, ["IN", "LIVES", "SITS"]).select("start", "end", "hops")


@query("subtree", f"WITH RECURSIVE {_FK}, w(root, id, depth) AS (SELECT 'r0', 'r0', 0 UNION ALL SELECT root, src, depth + 1 FROM w JOIN e ON dst = id) SELECT root, id, depth FROM w")
def subtree(spark, d):
    ev = fk_edges(spark, d).select(F.col("src").alias("id"), F.col("dst").alias("parent"))
    return graph.subtree(ev, spark.range(1).select(F.lit("r0").alias("id")))


@query("view_select", f"WITH {_FK}, t AS (SELECT 'n' || n_nationkey AS id FROM nation) SELECT DISTINCT 'n' || 't' AS task_id, src, dst, type FROM e WHERE src IN (SELECT id FROM t) OR dst IN (SELECT id FROM t)")
def view_select(spark, d):
    nodes, e = layered(spark, d)
    targets = table(spark, d, "nation").select(F.lit("nt").alias("task_id"), F.concat(F.lit("n"), text("n_nationkey")).alias("target"))
    return graph.task_view(nodes, e, targets)[1]


@query("view_induced", f"WITH {_FK}, k AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 0 UNION SELECT 'n' || n_nationkey FROM nation) SELECT src, dst, type FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)")
def view_induced(spark, d):
    keep = table(spark, d, "customer").where("c_acctbal > 0").select(F.concat(F.lit("c"), text("c_custkey")).alias("id")).union(table(spark, d, "nation").select(F.concat(F.lit("n"), text("n_nationkey"))))
    return graph.induced(keep, fk_edges(spark, d)).select("src", "dst", "type")


@query("newest_changes", "SELECT c, k FROM (SELECT o_custkey AS c, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r <= 10")
def newest_changes(spark, d):
    return codegraph.newest_per(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("k"))


# --- metrics

_PG = "p AS (SELECT lang, doc_id FROM documents WHERE n_chars > 1500), g AS (SELECT lang, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), j AS (SELECT coalesce(p.lang, g.lang) AS lang, p.doc_id AS p, g.doc_id AS g FROM p FULL JOIN g ON p.doc_id = g.doc_id), c AS (SELECT lang, count(*) FILTER (p IS NOT NULL AND g IS NOT NULL) AS tp, count(p) AS n_pred, count(g) AS n_gold FROM j GROUP BY 1)"


def set_tables(spark, d) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return docs.where("n_chars > 1500"), docs.join(table(spark, d, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")


def _prf_sql(p: str, r: str, places: int) -> str:
    return f"WITH {_PG}, x AS (SELECT *, {p} AS pr, {r} AS rc FROM c) SELECT lang, CAST(tp AS BIGINT) AS tp, CAST(n_pred AS BIGINT) AS n_pred, CAST(n_gold AS BIGINT) AS n_gold, round(pr, {places}) AS precision, round(rc, {places}) AS recall, round(CASE WHEN pr + rc = 0 THEN 0 ELSE 2 * pr * rc / (pr + rc) END, {places}) AS f1 FROM x"


_P0, _R0, _R1 = "CASE WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END", "CASE WHEN n_gold = 0 THEN 0 ELSE tp / n_gold END", "CASE WHEN n_gold = 0 THEN 1 ELSE tp / n_gold END"


@query("prf", _prf_sql(_P0, _R0, 4))
def prf(spark, d):
    return metrics.prf(metrics.set_counts(*set_tables(spark, d), ["lang"], ["doc_id"]))


@query("prf_lenient", _prf_sql(_P0, _R1, 3))
def prf_lenient(spark, d):
    return metrics.prf(metrics.set_counts(*set_tables(spark, d), ["lang"], ["doc_id"]), "lenient")


@query("prf_goldhit", _prf_sql("CASE WHEN n_gold = 0 THEN CAST(n_pred = 0 AS INTEGER) WHEN n_pred = 0 THEN 0 ELSE tp / n_pred END", _R1, 3))
def prf_goldhit(spark, d):
    return metrics.prf(metrics.set_counts(*set_tables(spark, d), ["lang"], ["doc_id"]), "goldhit")


@query("recall_at_k", f"WITH {_PG.split(', j AS')[0]}, k AS (SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents WHERE n_chars > 1500) WHERE r <= 10), c AS (SELECT coalesce(k.lang, g.lang) AS lang, count(*) FILTER (k.doc_id IS NOT NULL AND g.doc_id IS NOT NULL) AS tp, count(k.doc_id) AS n_pred, count(g.doc_id) AS n_gold FROM k FULL JOIN g ON k.doc_id = g.doc_id GROUP BY 1) SELECT lang, round({_R0}, 4) AS recall, round({_P0}, 4) AS precision, 10 AS k FROM c")
def recall_at_k(spark, d):
    p, g = set_tables(spark, d)
    return metrics.at_k(p, g, ["lang"], "doc_id", [F.desc("n_chars"), F.asc("doc_id")], 10).select("lang", "recall", "precision", "k")


@query("preservation", "WITH j AS (SELECT lang, doc_id, n_chars < 800 AS rb, n_chars >= 1200 AS kp FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT lang, round(count(*) FILTER (kp AND NOT rb) / count(*), 4) AS preservation, round(1 - count(*) FILTER (rb) / count(*), 4) AS preservation_kept, CAST(count(*) FILTER (rb) AS BIGINT) AS collateral FROM j GROUP BY 1")
def preservation(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return metrics.preservation(docs.where("n_chars < 800"), docs.where("n_chars >= 1200"), set_tables(spark, d)[1], ["lang"], "doc_id")


@query("macro_summary", "SELECT o_orderstatus AS task_type, o_orderpriority AS mode, round(avg(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice / 1000 END), 2) AS price, round(avg(CAST(o_custkey AS DOUBLE)), 2) AS cust FROM orders GROUP BY 1, 2")
def macro_summary(spark, d):
    s = table(spark, d, "orders").select(F.col("o_orderstatus").alias("task_type"), F.col("o_orderpriority").alias("mode"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") / 1000).alias("price"), F.col("o_custkey").alias("cust"))
    return metrics.macro_means(s, ["task_type", "mode"], ["price", "cust"], 2)


@query("stop_histogram", "SELECT coalesce(CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderpriority END, 'finished') AS stopped_at, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1")
def stop_histogram(spark, d):
    return metrics.stop_histogram(table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).alias("stopped_at")))


@query("ablation_summary", "SELECT o_orderpriority AS arm, round(avg(CASE WHEN r = 1 THEN 1.0::DOUBLE ELSE 0 END), 3) AS recall_1, round(avg(CASE WHEN coalesce(r, 99) <= 3 THEN 1.0::DOUBLE ELSE 0 END), 3) AS recall_3, round(avg(CASE WHEN o_custkey % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END), 3) AS mapping_accuracy, round(avg(CASE WHEN r IS NULL THEN 1.0::DOUBLE ELSE 0 END), 3) AS unresolved, CAST(sum(o_custkey) AS BIGINT) AS tokens FROM (SELECT *, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey % 5 + 1 END AS r FROM orders) GROUP BY 1")
def ablation_summary(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderpriority").alias("arm"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey") % 5 + 1).alias("rank"), (F.col("o_custkey") % 2 == 0).alias("mapped_ok"), F.col("o_custkey").alias("tokens"))
    return metrics.ablation_summary(rows)


@query("trace_summary", "SELECT event_type AS layer, CAST(count(*) AS BIGINT) AS events, CAST(count(*) FILTER (value > 50) AS BIGINT) AS failed FROM events GROUP BY 1")
def trace_summary(spark, d):
    return metrics.trace_summary(table(spark, d, "events").select(F.col("event_type").alias("layer"), F.when(F.col("value") > 50, "failed").otherwise("ok").alias("status")))


# --- rules and lifecycle

@query("policy_gate", """WITH x AS (SELECT o_orderkey, o_custkey % 3 = 0 AS same, o_orderpriority LIKE '1%' AS route, o_totalprice > 250000 AS mig, o_orderkey % 11 = 0 AS uns, o_orderkey % 13 = 0 AS inv, o_orderkey % 17 = 0 AS tst FROM orders)
SELECT o_orderkey, CASE WHEN uns THEN 'unsupported_finding' WHEN inv THEN 'invalid_graph_path' WHEN tst THEN 'unresolved_test_failure' WHEN same THEN 'rollback_keep_same_symbol' WHEN route THEN 'rollback_public_api' WHEN mig THEN 'db_migration_change' END AS rule, CASE WHEN uns OR inv OR tst THEN 'BLOCK' WHEN same OR route OR mig THEN 'HUMAN_REVIEW' ELSE 'PASS' END AS action, CASE WHEN uns OR inv OR tst THEN 'high' WHEN same OR route OR mig THEN 'medium' ELSE 'low' END AS risk FROM x""")
def policy_gate(spark, d):
    key = F.col("o_orderkey")
    ctx = table(spark, d, "orders").select(
        "o_orderkey", F.array(F.lit("a")).alias("rollback_symbols"), F.array(F.when(F.col("o_custkey") % 3 == 0, "a").otherwise("b")).alias("keep_symbols"), F.array(F.when(F.col("o_orderpriority").like("1%"), "/api/x").otherwise("")).alias("affected_routes"),
        F.array(F.when(F.col("o_totalprice") > 250000, "db/Migration1").otherwise("src/a.ts")).alias("changed_files"), (key % 11 == 0).cast("int").alias("unsupported_findings"), (key % 13 == 0).cast("int").alias("invalid_graph_paths"), (key % 17 == 0).cast("int").alias("unresolved_test_failures"),
    )
    return policy.analysis_gate(ctx).select("o_orderkey", "rule", "action", "risk")


@query("exec_gate", """WITH x AS (SELECT o_orderkey, o_orderpriority LIKE '1%' AS pub, o_orderpriority LIKE '2%' AS aut, o_custkey % 3 = 0 AS same, o_orderkey % 5 = 0 AS scope, o_orderkey % 7 = 0 AS stale, o_orderkey % 9 = 0 AS test FROM orders)
SELECT o_orderkey, CASE WHEN stale THEN 'repository_state_changed' WHEN test THEN 'test_failed' WHEN scope THEN 'unexpected_file_change' WHEN aut THEN 'auth_change' WHEN pub THEN 'public_api_change' WHEN same THEN 'same_symbol_rollback_keep' END AS rule, CASE WHEN stale OR test OR scope THEN 'BLOCK' WHEN aut OR pub OR same THEN 'HUMAN_REVIEW' ELSE 'PASS' END AS action FROM x""")
def exec_gate(spark, d):
    key = F.col("o_orderkey")
    attempts = table(spark, d, "orders").select(
        "o_orderkey", F.array(F.when(F.col("o_orderpriority").like("2%"), "src/Login.ts").otherwise("src/x.ts")).alias("target_files"), F.array().cast("array<string>").alias("target_symbols"),
        F.when(F.col("o_orderpriority").like("1%"), F.array(F.lit("/x"))).otherwise(F.array().cast("array<string>")).alias("routes"), F.array(F.lit("f::a")).alias("rollback_symbols"), F.array(F.when(F.col("o_custkey") % 3 == 0, "g::a").otherwise("g::b")).alias("keep_symbols"),
        F.when(key % 7 == 0, "STALE_PLAN").otherwise("VALIDATED").alias("status"), F.when(key % 5 == 0, F.lit(False)).alias("scope_pass"), F.lit(None).cast("boolean").alias("preservation_pass"), F.array(F.when(key % 9 == 0, "FAILED").otherwise("PASSED")).alias("results"),
    )
    return policy.post_gate(attempts).select("o_orderkey", "rule", "action")


@query("recommendation", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'BLOCK' WHEN o_custkey % 4 = 0 THEN 'HUMAN_REVIEW' WHEN o_orderstatus = 'P' THEN 'HUMAN_REVIEW' WHEN o_orderkey % 3 <> 0 THEN 'UNGATED' ELSE 'PASS' END AS advice FROM orders")
def recommendation(spark, d):
    action = F.when(F.col("o_orderstatus") == "F", "BLOCK").when(F.col("o_orderstatus") == "P", "HUMAN_REVIEW").otherwise("PASS")
    return table(spark, d, "orders").select("o_orderkey", policy.recommendation(action, F.col("o_custkey") % 4 == 0, F.col("o_orderkey") % 3 == 0).alias("advice"))


@query("capability_check", "SELECT DISTINCT event_type, CAST(event_id % 3 AS BIGINT) AS k, event_type LIKE 'c%' OR event_type || '.' || (event_id % 3) = 'view.1' AS allowed FROM events")
def capability_check(spark, d):
    req = table(spark, d, "events").select(F.lit("s").alias("skill"), F.concat_ws(".", "event_type", (F.col("event_id") % 3).cast("string")).alias("capability"), "event_type", (F.col("event_id") % 3).alias("k")).distinct()
    grants = spark.range(2).select(F.lit("s").alias("skill"), F.when(F.col("id") == 0, "click.*").otherwise("view.1").alias("pattern"))
    return policy.capability_allowed(req, grants).select("event_type", "k", "allowed")


_STATES = fixed.CHAIN[:5]


@query("state_machine", """WITH h AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'view' THEN 'PLANNED' WHEN 'click' THEN 'PREPARED' WHEN 'signup' THEN 'PATCH_BUILT' WHEN 'purchase' THEN 'APPLY_CHECKED' ELSE 'CONFLICT' END AS s FROM events),
l AS (SELECT *, lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM h)
SELECT p AS prev, s AS next, CAST(count(*) AS BIGINT) AS n FROM l WHERE p IS NOT NULL AND NOT ((p, s) IN (('PLANNED', 'PREPARED'), ('PREPARED', 'PATCH_BUILT'), ('PATCH_BUILT', 'APPLY_CHECKED'), ('PREPARED', 'CONFLICT'), ('PATCH_BUILT', 'CONFLICT'), ('APPLY_CHECKED', 'CONFLICT'))) GROUP BY 1, 2""")
def state_machine(spark, d):
    names = F.create_map(*[F.lit(x) for kv in (("view", "PLANNED"), ("click", "PREPARED"), ("signup", "PATCH_BUILT"), ("purchase", "APPLY_CHECKED"), ("error", "CONFLICT")) for x in kv])
    h = table(spark, d, "events").select(F.col("user_id").alias("execution_id"), F.struct("ts", "event_id").alias("ord"), F.element_at(names, F.col("event_type")).alias("status"))
    return lifecycle.illegal_transitions(h, lifecycle.transition_table(spark)).groupBy("prev", "next").agg(F.count("*").alias("n"))


@query("latest_attempt", "SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS ord FROM events GROUP BY 1")
def latest_attempt(spark, d):
    h = table(spark, d, "events").select("user_id", F.col("event_type").alias("status"), F.col("event_id").alias("ord"))
    return lifecycle.latest(h, "user_id")


@query("verification_faces", "SELECT o_orderkey, CASE WHEN a AND b AND c AND d AND e THEN 'VERIFIED' WHEN a AND b AND c THEN 'PARTIAL' ELSE 'FAILED' END AS overall FROM (SELECT o_orderkey, o_orderkey % 7 <> 0 AS a, o_custkey % 5 <> 0 AS b, o_orderkey % 3 <> 0 AS c, o_custkey % 2 = 0 AS d, o_orderkey % 11 <> 0 AS e FROM orders)")
def verification_faces(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    faces = table(spark, d, "orders").select("o_orderkey", (k % 7 != 0).alias("expected"), (c % 5 != 0).alias("preservation"), (k % 3 != 0).alias("scope"), (c % 2 == 0).alias("tests"), (k % 11 != 0).alias("evidence"))
    return lifecycle.verification(faces).select("o_orderkey", "overall")


@query("validation_status", "SELECT l_orderkey AS execution_id, CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'TEST_FAILED' ELSE 'VALIDATED' END AS status, count(*) FILTER (l_returnflag = 'A') = 0 AS tests FROM lineitem GROUP BY 1")
def validation_status(spark, d):
    r = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("execution_id"), F.when(F.col("l_returnflag") == "A", "FAILED").otherwise("PASSED").alias("result"))
    return lifecycle.validation_status(r)


@query("promotion_reasons", "SELECT o_orderkey, concat_ws('; ', CASE WHEN o_custkey % 3 = 0 THEN 'no explicit approval' END, CASE WHEN o_orderstatus <> 'O' THEN 'not ready' END, CASE WHEN o_orderkey % 4 = 0 THEN 'patch differs from the verified one' END) AS reasons FROM orders")
def promotion_reasons(spark, d):
    k = F.col("o_orderkey")
    a = table(spark, d, "orders").select("o_orderkey", F.lit(True).alias("promote_enabled"), F.lit(False).alias("auto_push"), (F.col("o_custkey") % 3 != 0).alias("explicit_approval"), F.when(F.col("o_orderstatus") == "O", "READY_TO_PROMOTE").otherwise("VERIFIED").alias("status"), F.lit("x").alias("patch_sha"), F.when(k % 4 == 0, "y").otherwise("x").alias("verified_sha"), F.lit(False).alias("stale"))
    return a.select("o_orderkey", F.array_join(policy.promotion_reasons(), "; ").alias("reasons"))


@query("inverse_hunk", "SELECT conv_id, string_agg(CASE turn % 3 WHEN 0 THEN '-' WHEN 1 THEN '+' ELSE ' ' END || md5(text), '|' ORDER BY turn, md5(text)) AS lines, CAST(count(*) AS BIGINT) AS old_lines FROM conversations GROUP BY 1")
def inverse_hunk(spark, d):
    tag = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.col("turn") % 3 + 1).cast("int"))
    h = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("text"), tag.alias("tag")))), lambda x: F.struct(x.tag.alias("tag"), x.text.alias("text"))).alias("lines"), F.count("*").alias("new_lines"), F.lit(0).cast("bigint").alias("old_lines"), F.lit(1).alias("old_start"), F.lit(1).alias("new_start"))
    inv = lifecycle.inverse_hunks(h)
    return inv.select("conv_id", F.array_join(F.transform("lines", lambda x: F.concat(x.tag, x.text)), "|").alias("lines"), "old_lines")


@query("patch_signature", "SELECT conv_id, string_agg(s, '|' ORDER BY s) AS signature FROM (SELECT conv_id, CASE turn % 3 WHEN 0 THEN '+' ELSE '-' END || md5(text) AS s FROM conversations WHERE turn % 3 < 2) GROUP BY 1")
def patch_signature(spark, d):
    tag = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(" ")), (F.col("turn") % 3 + 1).cast("int"))
    h = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("sha")).agg(F.lit("f").alias("file"), F.collect_list(F.struct(tag.alias("tag"), F.md5("text").alias("text"))).alias("lines"))
    return lifecycle.patch_signature(h).select(F.col("sha").alias("conv_id"), F.array_join(F.transform("signature", lambda x: F.concat(x.tag, x.text)), "|").alias("signature"))


@query("missing_hunks", "SELECT o_orderkey AS sha, n AS idx FROM orders, (VALUES (1), (3)) t(n) WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = n)")
def missing_hunks(spark, d):
    refs = table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.lit("f").alias("file"), F.explode(F.array(F.lit(1), F.lit(3))).alias("idx"))
    hunks = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.lit("f").alias("file"), F.col("l_linenumber").alias("idx"))
    return lifecycle.missing_hunks(refs, hunks).select("sha", "idx")
