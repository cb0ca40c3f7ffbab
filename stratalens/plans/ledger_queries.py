"""Registers, verification faces, patches on line tables, traces and names over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.operators import codegraph, evidence, graph, ledger, lifecycle, metrics, policy, semantic, units
from stratalens.operators.scratch import dealt, written

from .fact_queries import _FK, fk_edges, layered, text
from .registry import query
from .search_queries import table


_ITEMS = "items AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)"


def items(spark, d) -> DataFrame:
    """One row for each numbered line of an order."""
    li = table(spark, d, "lineitem")
    return dealt(li.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"), li.count(), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_returnflag", "l_linestatus")])


@query("app_roles", r"""WITH p AS (SELECT CASE page_id % 6 WHEN 0 THEN 'src/app/x' || page_id || '/route.ts' WHEN 1 THEN 'app/page.tsx' WHEN 2 THEN 'app/y/z' || page_id || '/layout.tsx' WHEN 3 THEN 'app/app/route.ts' WHEN 4 THEN 'lib/page.tsx' ELSE 'app/y/notes.md' END AS path, page_id FROM pages)
SELECT DISTINCT path AS file, CASE page_id % 6 WHEN 1 THEN 'page' WHEN 2 THEN 'layout' ELSE 'api' END AS role, CASE page_id % 6 WHEN 0 THEN '/x' || page_id WHEN 1 THEN '/' WHEN 2 THEN '/y/z' || page_id ELSE '/app' END AS route_path FROM p WHERE page_id % 6 < 4""")
def app_roles(spark, d):
    k, n = F.col("page_id") % 6, text("page_id")
    path = F.when(k == 0, F.concat(F.lit("src/app/x"), n, F.lit("/route.ts"))).when(k == 1, "app/page.tsx").when(k == 2, F.concat(F.lit("app/y/z"), n, F.lit("/layout.tsx"))).when(k == 3, "app/app/route.ts").when(k == 4, "lib/page.tsx").otherwise("app/y/notes.md")
    return codegraph.app_roles(table(spark, d, "pages").select(path.alias("path")).distinct())


_ARGV = ["log -n", "push", "apply --check -R", "apply --cached", "worktree add x", "worktree add --detach x", "worktree lock x", "diff --stat", "diff --color", "rev-parse HEAD", "read-tree x", "hash-object f"]
_READ, _BOX = [0, 7, 8, 9], [2, 5, 7, 9, 11]


@query("git_guard", f"WITH a AS (SELECT DISTINCT user_id, event_type, CAST(user_id % {len(_ARGV)} AS INTEGER) AS k FROM events) SELECT user_id, event_type, k IN ({', '.join(map(str, _READ))}) AS reads, k IN ({', '.join(map(str, _BOX))}) AS sandbox FROM a")
def git_guard(spark, d):
    argv = F.split(F.element_at(F.array(*[F.lit(x) for x in _ARGV]), (F.col("user_id") % len(_ARGV) + 1).cast("int")), " ")
    e = table(spark, d, "events").select("user_id", "event_type").distinct()
    return e.select("user_id", "event_type", policy.allowed_git(argv).alias("reads"), policy.allowed_git(argv, sandbox=True).alias("sandbox"))


# --- findings and conflicts

def _findings(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """findings over orders, evidence over customers in credit, conflicts between a pending order and the next one."""
    o = table(spark, d, "orders")
    f = o.select(F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_totalprice") < 20000, F.array().cast("array<bigint>")).otherwise(F.array("o_custkey")).alias("evidence_ids"), F.lit("proposed").alias("status"))
    e = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return f, e, o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"), F.col("o_orderpriority").alias("topic"))


@query("finding_transitions", """WITH w AS (SELECT o_orderkey AS finding_id, CASE left(o_orderpriority, 1) WHEN '1' THEN 'verified' WHEN '2' THEN 'verified' WHEN '3' THEN 'unsupported' WHEN '4' THEN 'contradicted' ELSE 'done' END AS wanted, o_totalprice < 20000 AS bare, o_custkey FROM orders UNION ALL SELECT -1 - c_custkey, 'verified', NULL, NULL FROM customer),
h AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_orderkey + 1 FROM orders WHERE o_orderstatus = 'P'),
x AS (SELECT finding_id, wanted, CASE WHEN bare IS NULL THEN 'unknown finding' WHEN wanted = 'done' THEN 'invalid status' WHEN wanted = 'verified' AND bare THEN 'no evidence cited' WHEN wanted = 'verified' AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) THEN 'unregistered evidence' WHEN wanted = 'verified' AND finding_id IN (SELECT k FROM h) THEN 'unresolved conflict' END AS error FROM w)
SELECT finding_id, CASE WHEN error IS NULL THEN wanted WHEN error <> 'unknown finding' THEN 'proposed' END AS status, error FROM x""")
def finding_transitions(spark, d):
    f, e, hot = _findings(spark, d)
    k = F.left("o_orderpriority", F.lit(1))
    wanted = F.when(k.isin("1", "2"), "verified").when(k == "3", "unsupported").when(k == "4", "contradicted").otherwise("done")
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("finding_id"), wanted.alias("status")).union(table(spark, d, "customer").select(-1 - F.col("c_custkey"), F.lit("verified")))
    return evidence.transition_findings(f, asked, e, hot)


@query("conflicts_open", "SELECT o_orderkey AS a, o_orderkey + 1 AS b, o_orderpriority AS topic FROM orders o WHERE o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R')")
def conflicts_open(spark, d):
    decided = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + 1).alias("b"))
    return evidence.open_conflicts(_findings(spark, d)[2], decided)


@query("conflicts_involving", "WITH c AS (SELECT o_orderkey AS a, o_orderkey + 1 AS b, o_orderpriority AS topic FROM orders WHERE o_orderstatus = 'P') SELECT f AS finding_id, a, b, topic FROM (SELECT a AS f, * FROM c UNION ALL SELECT b, * FROM c) WHERE f IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 100000)")
def conflicts_involving(spark, d):
    return evidence.conflicts_involving(_findings(spark, d)[2], table(spark, d, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("finding_id")))


@query("conflict_decisions", "SELECT 'conflict_resolution' AS category, o_orderpriority AS target, CAST(o_custkey AS VARCHAR) AS statement, 'medium' AS risk, o_orderkey || ',' || (o_orderkey + 1) AS related, 'winner=' || CASE WHEN o_totalprice > 100000 THEN CAST(o_orderkey AS VARCHAR) ELSE 'none' END AS reason FROM orders WHERE o_orderstatus = 'P'")
def conflict_decisions(spark, d):
    made = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + 1).alias("b"), F.when(F.col("o_totalprice") > 100000, F.col("o_orderkey")).alias("winner"), F.col("o_custkey").alias("decision_id"))
    return evidence.conflict_decisions(_findings(spark, d)[2], made).withColumn("related", F.array_join(F.transform("related", lambda x: x.cast("string")), ","))


@query("gate_decisions", "SELECT 'policy_gate' AS category, CAST(o_orderkey AS VARCHAR) AS target, CASE WHEN o_orderpriority LIKE '1%' THEN 'rollback_public_api: HUMAN_REVIEW' ELSE 'no rule: PASS' END AS statement FROM orders")
def gate_decisions(spark, d):
    none = F.array().cast("array<string>")
    ctx = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderpriority").like("1%"), F.array(F.lit("/r"))).otherwise(none).alias("affected_routes"), none.alias("rollback_symbols"), none.alias("keep_symbols"), none.alias("changed_files"), *[F.lit(0).alias(c) for c in ("unsupported_findings", "invalid_graph_paths", "unresolved_test_failures")])
    return policy.gate_decisions(policy.analysis_gate(ctx), "o_orderkey").select("category", "target", "statement")


# --- verification faces and patches

def _hunks(spark, d, where: str, tag: str, word: str) -> DataFrame:
    li = table(spark, d, "lineitem").where(where)
    return li.select(F.col("l_orderkey").alias("sha"), F.concat(F.lit("f"), F.col("l_partkey") % 7).alias("file"), F.array(F.struct(F.lit(tag).alias("tag"), F.expr(word).cast("string").alias("text"))).alias("lines"))


_H = "h AS (SELECT l_orderkey AS sha, 'f' || (l_partkey % 7) AS file, l_returnflag AS flag, l_linestatus AS st, l_suppkey % 5 AS put, l_linenumber % 5 AS gone FROM lineitem)"


@query("preservation_face", f"""WITH {_H}, k AS (SELECT * FROM h WHERE flag = 'N'), r AS (SELECT DISTINCT sha, file FROM h WHERE flag = 'R'), a AS (SELECT * FROM h WHERE st = 'F'),
b AS (SELECT sha FROM k WHERE (sha, file) NOT IN (SELECT sha, file FROM r) AND (sha, file) IN (SELECT sha, file FROM a)
UNION SELECT k.sha FROM k JOIN a ON a.sha = k.sha AND a.file = k.file AND a.gone = k.put WHERE (k.sha, k.file) IN (SELECT sha, file FROM r))
SELECT DISTINCT sha, sha NOT IN (SELECT sha FROM b) AS preservation FROM a""")
def preservation_face(spark, d):
    word = "l_suppkey % 5"
    return lifecycle.preservation_face(_hunks(spark, d, "l_returnflag = 'N'", "+", word), _hunks(spark, d, "l_returnflag = 'R'", "+", word), _hunks(spark, d, "l_linestatus = 'F'", "-", "l_linenumber % 5"))


@query("scope_face", f"""WITH {_H}, a AS (SELECT DISTINCT sha, file FROM h WHERE st = 'F'), p AS (SELECT sha, file FROM h WHERE flag <> 'R'), x AS (SELECT sha, string_agg(file, ',' ORDER BY file) AS l FROM (SELECT * FROM a WHERE (sha, file) NOT IN (SELECT sha, file FROM p)) GROUP BY 1),
z AS (SELECT DISTINCT o_orderkey AS sha FROM orders WHERE o_orderstatus = 'P')
SELECT DISTINCT a.sha, x.l IS NULL AND a.sha NOT IN (SELECT sha FROM z) AS scope, coalesce(x.l, '') AS outside FROM a LEFT JOIN x ON x.sha = a.sha""")
def scope_face(spark, d):
    drift = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("sha"))
    out = lifecycle.scope_face(_hunks(spark, d, "l_linestatus = 'F'", "-", "l_linenumber"), _hunks(spark, d, "l_returnflag <> 'R'", "+", "l_linenumber"), drift)
    return out.withColumn("outside", F.array_join("outside", ","))


@query("evidence_face", "SELECT o_orderkey AS sha, o_totalprice >= 20000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AND o_orderstatus <> 'P' AND o_orderpriority NOT LIKE '5%' AS evidence FROM orders")
def evidence_face(spark, d):
    f, e, _ = _findings(spark, d)
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("finding_id"), (F.col("o_orderstatus") != "P").alias("has_patches"), (~F.col("o_orderpriority").like("5%")).alias("has_snapshot"))
    return lifecycle.evidence_face(f.join(o, "finding_id").withColumnRenamed("finding_id", "sha"), e)


_APPLY = f"WITH {_ITEMS}" + """, l AS (SELECT l_orderkey AS path, l_linenumber AS n, CAST(l_partkey AS VARCHAR) AS t FROM items), o AS (SELECT o_orderkey AS path, o_orderstatus AS s FROM orders WHERE EXISTS (SELECT 1 FROM l WHERE path = o_orderkey AND n = 1)),
c AS (SELECT o.path, o.s, CASE WHEN s = 'O' AND t <> 'x' THEN 'CONFLICT' ELSE 'APPLIED_SANDBOX' END AS status FROM o JOIN l ON l.path = o.path AND n = 1)
"""


def _applied(spark, d) -> tuple[DataFrame, DataFrame]:
    """Orders as files, line items as lines: F replaces the first line by two, O expects another first line, P inserts after it."""
    lines = items(spark, d).select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line_no"), text("l_partkey").alias("text"))
    first = lines.where("line_no = 1").select(F.col("path").alias("o_orderkey"), F.col("text").alias("first"))
    row = lambda tag, word: F.struct(F.lit(tag).alias("tag"), word.cast("string").alias("text"))
    s = F.col("o_orderstatus")
    body = F.when(s == "F", F.array(row("-", F.col("first")), row("+", F.lit("new a")), row("+", F.lit("new b")))).when(s == "O", F.array(row("-", F.lit("x")), row("+", F.lit("y")))).otherwise(F.array(row("+", F.lit("ins"))))
    hunks = table(spark, d, "orders").join(first, "o_orderkey").select(F.col("o_orderkey").alias("file"), F.lit(0).alias("idx"), F.lit(1).alias("old_start"), F.when(s == "P", 0).otherwise(1).alias("old_lines"), body.alias("lines"))
    return lifecycle.apply_hunks(lines, hunks)


@query("apply_hunks", _APPLY + """, r AS (SELECT l.path, n * 10 AS pl, t FROM l LEFT JOIN c ON c.path = l.path WHERE c.s IS DISTINCT FROM 'F' OR n <> 1 UNION ALL SELECT path, 10, 'new a' FROM c WHERE s = 'F' UNION ALL SELECT path, 11, 'new b' FROM c WHERE s = 'F' UNION ALL SELECT path, 11, 'ins' FROM c WHERE s = 'P')
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY pl) AS INTEGER) AS line_no, t AS text FROM r""")
def apply_hunks(spark, d):
    return _applied(spark, d)[0]


@query("apply_status", _APPLY + " SELECT path, status FROM c")
def apply_status(spark, d):
    return _applied(spark, d)[1]


@query("prepare_status", "WITH m AS (SELECT p_partkey AS k FROM part WHERE p_size > 45) SELECT l_orderkey AS execution_id, CASE WHEN count(*) FILTER (l_partkey IN (SELECT k FROM m)) > 0 THEN 'STALE_PLAN' ELSE 'PREPARED' END AS status FROM lineitem GROUP BY 1")
def prepare_status(spark, d):
    p = table(spark, d, "part")
    was = p.select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("hash"))
    now = p.select(F.col("p_partkey").alias("path"), F.when(F.col("p_size") > 45, "x").otherwise(F.col("p_brand")).alias("hash"))
    return lifecycle.prepare(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("execution_id"), F.col("l_partkey").alias("path")), was, now)


@query("patch_status", f"WITH {_ITEMS} SELECT l_orderkey AS sha, CASE WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'CONFLICT' ELSE 'PATCH_BUILT' END AS status FROM items GROUP BY 1")
def patch_status(spark, d):
    li = items(spark, d).select(F.col("l_orderkey").alias("sha"), F.lit("f").alias("file"), F.col("l_linenumber").alias("idx"), "l_returnflag")
    return lifecycle.patch_status(li, li.where("l_returnflag <> 'A'"))


@query("collateral_callers", """WITH x AS (SELECT DISTINCT l_orderkey AS sha, l_suppkey AS file, 's' || (l_partkey % 50) AS sym, CASE WHEN l_returnflag = 'R' THEN 'ROLLBACK' ELSE 'KEEP' END AS a FROM lineitem),
calls AS (SELECT DISTINCT 's' || (p_partkey % 50) AS callee, p_size AS file FROM part),
s AS (SELECT DISTINCT sha FROM (SELECT sha, file FROM x GROUP BY 1, 2 HAVING count(DISTINCT a) > 1)), b AS (SELECT sha, count(*) FILTER (a = 'ROLLBACK') AS n FROM x GROUP BY 1),
h AS (SELECT r.sha, count(DISTINCT r.sym) AS n FROM x r JOIN calls c ON c.callee = r.sym JOIN x k ON k.sha = r.sha AND k.file = c.file AND k.a = 'KEEP' WHERE r.a = 'ROLLBACK' GROUP BY 1)
SELECT b.sha, round(least(1.0::DOUBLE, CASE WHEN b.sha IN (SELECT sha FROM s) THEN 0.35::DOUBLE ELSE 0 END + 0.15::DOUBLE * coalesce(h.n, 0) + CASE WHEN b.n = 0 THEN 0.2::DOUBLE ELSE 0 END), 3) AS risk FROM b LEFT JOIN h ON h.sha = b.sha""")
def collateral_callers(spark, d):
    # a null supplier on both sides is a shared file here, as in the SQL, and no call's file
    u = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.array(F.coalesce(text("l_suppkey"), F.lit(""))).alias("files"), F.array(F.concat(F.lit("f::s"), F.col("l_partkey") % 50)).alias("symbols"), F.when(F.col("l_returnflag") == "R", "ROLLBACK").otherwise("KEEP").alias("action"))
    calls = table(spark, d, "part").select(F.concat(F.lit("s"), F.col("p_partkey") % 50).alias("callee_short"), text("p_size").alias("caller_file"))
    return units.collateral_risk(u, calls).select("sha", "risk")


# --- traces, costs, names

@query("trail_names", "WITH n AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'agent:' || event_type || ':a:b' WHEN 1 THEN 'skill:' || event_type || ':run' WHEN 2 THEN event_type || ':x:y' ELSE 'agent:' || event_type END AS name FROM events) SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'agent' WHEN 1 THEN 'skill' ELSE 'tool' END AS layer, CASE event_id % 4 WHEN 3 THEN 'agent' ELSE string_split(replace(replace(name, 'agent:', ''), 'skill:', ''), ':')[1] END AS actor, CASE event_id % 4 WHEN 0 THEN 'a:b' WHEN 1 THEN 'run' WHEN 2 THEN 'y' ELSE string_split(name, ':')[2] END AS action FROM n")
def trail_names(spark, d):
    k, t = F.col("event_id") % 4, F.col("event_type")
    name = F.when(k == 0, F.concat(F.lit("agent:"), t, F.lit(":a:b"))).when(k == 1, F.concat(F.lit("skill:"), t, F.lit(":run"))).when(k == 2, F.concat(t, F.lit(":x:y"))).otherwise(F.concat(F.lit("agent:"), t))
    return table(spark, d, "events").select("event_id", ledger.trail_name(name).alias("n")).select("event_id", "n.*")


@query("trace_spans", f"""WITH {_ITEMS} SELECT l_orderkey AS run, l_linenumber AS trace_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS depth, CASE WHEN l_returnflag = 'A' THEN 'running' WHEN l_returnflag = 'R' THEN 'failed' ELSE 'ok' END AS status,
CASE WHEN l_returnflag <> 'A' THEN CAST(1000 - 20 * l_linenumber AS BIGINT) END AS duration_ms, l_linestatus AS warnings FROM items""")
def trace_spans(spark, d):
    li, n = items(spark, d), F.col("l_linenumber").cast("bigint")
    row = lambda df, kind, at, said: df.select(F.col("l_orderkey").alias("run"), at.alias("ord"), F.lit(kind).alias("kind"), F.col("l_linenumber").alias("trace_id"), said.cast("string").alias("text"), at.alias("ms"))
    e = row(li, "begin", 10 * n, F.lit(None)).union(row(li, "warn", 10 * n + 1, F.col("l_linestatus"))).union(row(li.where("l_returnflag <> 'A'"), "end", 1000 - 10 * n, F.when(F.col("l_returnflag") == "R", "failed")))
    return ledger.span_events(e).select("run", "trace_id", "depth", "status", "duration_ms", F.array_join("warnings", ",").alias("warnings"))


@query("trace_lines", f"WITH {_ITEMS}" + " SELECT 'o' || l_orderkey AS root, l_linenumber AS ord, '{\"id\":\"o' || l_orderkey || '-' || l_linenumber || '\",\"ord\":' || l_linenumber || ',\"layer\":\"' || l_returnflag || '\"}' AS line FROM items UNION ALL SELECT DISTINCT 'o' || l_orderkey, 0, '{\"id\":\"o' || l_orderkey || '\",\"ord\":0}' FROM items")
def trace_lines(spark, d):
    li = items(spark, d)
    root = F.concat(F.lit("o"), text("l_orderkey"))
    kids = li.select(F.concat_ws("-", root, text("l_linenumber")).alias("id"), root.alias("parent"), F.col("l_linenumber").alias("ord"), F.col("l_returnflag").alias("layer"))
    tops = li.groupBy("l_orderkey").agg(F.lit(None).cast("string").alias("parent"))
    e = written(kids.union(tops.select(root, "parent", F.lit(0), F.col("parent"))), "events")  # read by each step of the subtrees
    return ledger.trace_lines(e, graph.subtree(e, e.where("parent IS NULL").select("id")), ["id", "ord", "layer"])


@query("run_costs", "SELECT user_id, CAST(count(*) FILTER (event_type = 'click') AS BIGINT) AS calls, CAST(coalesce(sum(event_id % 100) FILTER (event_type = 'view'), 0) AS BIGINT) AS context_chars, CAST(count(*) FILTER (event_type = 'view') AS BIGINT) AS context_items, CAST(count(*) FILTER (event_type NOT IN ('click', 'view')) AS BIGINT) AS warnings, CAST(max(event_id) - min(event_id) AS BIGINT) AS latency FROM events GROUP BY 1")
def run_costs(spark, d):
    kind = F.when(F.col("event_type") == "click", "tool").when(F.col("event_type") == "view", "context").otherwise("warning")
    calls = table(spark, d, "events").select("user_id", kind.alias("kind"), (F.col("event_id") % 100).alias("chars"), F.lit(1).alias("items"), F.col("event_id").alias("start"), F.col("event_id").alias("end"))
    return ledger.run_costs(calls, ["user_id"])


@query("produced_ids", "WITH r AS (SELECT DISTINCT p_size AS role, CASE left(p_type, 1) WHEN 'S' THEN 'finding' WHEN 'P' THEN 'decision' ELSE 'evidence' END AS kind, p_partkey AS id FROM part) SELECT role, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (kind = 'evidence'), '') AS evidence_ids, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (kind = 'finding'), '') AS finding_ids, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) FILTER (kind = 'decision'), '') AS decision_ids FROM r GROUP BY 1")
def produced_ids(spark, d):
    k = F.left("p_type", F.lit(1))
    rows = table(spark, d, "part").select(F.col("p_size").alias("role"), F.when(k == "S", "finding").when(k == "P", "decision").otherwise("evidence").alias("kind"), F.col("p_partkey").alias("id"))
    out = ledger.produced(rows)
    return out.select("role", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("evidence_ids", "finding_ids", "decision_ids")])


@query("provenance", "SELECT l_partkey AS id, CAST(count(*) AS BIGINT) AS n, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS first FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY 1")
def provenance(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("source"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return ledger.sources_of(li, table(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("id")))


_PREFIX = "CASE p_size % 5 WHEN 0 THEN 'sym:' WHEN 1 THEN 'scope:' WHEN 2 THEN 'file:' WHEN 3 THEN '' END"


@query("anchors", f"SELECT 'p' || p_partkey || '.ts::s' AS name, coalesce({_PREFIX} || 'p' || p_partkey || '.ts::s', 'p' || p_partkey || '.ts::s') AS id, CASE p_size % 5 WHEN 0 THEN 'p' || p_partkey || '.ts' WHEN 2 THEN 'p' || p_partkey || '.ts::s' END AS file FROM part")
def anchors(spark, d):
    p = table(spark, d, "part")
    name = F.concat(F.lit("p"), text("p_partkey"), F.lit(".ts::s"))
    nodes = p.where("p_size % 5 < 4").select(F.concat(F.expr(_PREFIX), name).alias("id"))
    return ledger.anchors(p.select(name.alias("name")), nodes).select("name", "id", ledger.file_of(F.col("id")).alias("file"))


@query("file_history", "SELECT file, CAST(k AS INTEGER) AS k, sha FROM (SELECT l_partkey AS file, l_orderkey AS sha, row_number() OVER (PARTITION BY l_partkey ORDER BY o_orderdate DESC, l_orderkey DESC) AS k FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) JOIN orders ON o_orderkey = l_orderkey) WHERE k <= 3")
def file_history(spark, d):
    cf = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("file"))
    return ledger.file_history(cf, table(spark, d, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_orderdate").alias("ord")), cf.select("file"), 3)


# --- matching, labels, views, targets

@query("gold_symbols", "WITH g AS (SELECT p_size AS k, p_brand || '::' || p_name AS gold FROM part), p AS (SELECT DISTINCT p_size AS k, CASE WHEN p_type LIKE 'P%' THEN 'other::' || p_name ELSE p_type END AS pred FROM part) SELECT DISTINCT g.k, gold FROM g JOIN p ON p.k = g.k AND (contains(gold, pred) OR contains(pred, gold) OR string_split(gold, '::')[-1] = string_split(pred, '::')[-1])")
def gold_symbols(spark, d):
    p = table(spark, d, "part")
    pred = F.when(F.col("p_type").like("P%"), F.concat(F.lit("other::"), "p_name")).otherwise(F.col("p_type"))
    return metrics.tolerant_hits(p.select(F.col("p_size").alias("k"), F.concat_ws("::", "p_brand", "p_name").alias("gold")), p.select(F.col("p_size").alias("k"), pred.alias("pred")).distinct(), ["k"])


@query("gold_files", "SELECT DISTINCT o_orderkey AS k, l_partkey AS gold FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' WHERE EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = o_orderkey AND x.l_partkey = lineitem.l_partkey AND x.l_linestatus = 'F')")
def gold_files(spark, d):
    li = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "k")
    return metrics.exact_hits(li.where("l_returnflag = 'R'").select("k", F.col("l_partkey").alias("gold")), li.where("l_linestatus = 'F'").select("k", F.col("l_partkey").alias("pred")), ["k"])


@query("label_accuracy", "SELECT lang AS arm, CAST(count(*) AS BIGINT) AS units, round(avg(CASE WHEN quality = toxic THEN 1.0::DOUBLE ELSE 0 END), 3) AS label_accuracy, round(coalesce(avg(CASE WHEN toxic = 0 THEN CASE WHEN quality = 1 THEN 1.0::DOUBLE ELSE 0 END END), 0), 3) AS mapping_accuracy, round(avg(CASE WHEN toxic = 0 THEN 1.0::DOUBLE ELSE 0 END), 3) AS coverage FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def label_accuracy(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return metrics.label_accuracy(rows.select(F.col("lang").alias("arm"), F.col("quality").alias("label"), F.col("toxic").alias("gold"), F.when(F.col("toxic") == 0, F.col("quality") == 1).alias("mapped")))


@query("view_digest", f"WITH {_FK}, l AS (SELECT DISTINCT 'n' || n_nationkey AS task_id, src || ' -' || type || '-> ' || dst AS line FROM nation JOIN e ON src = 'n' || n_nationkey OR dst = 'n' || n_nationkey) SELECT task_id, sha256(left(string_agg(line, chr(10) ORDER BY line), 600)) AS digest, CAST(least(600, sum(length(line) + 1) - 1) AS INTEGER) AS n_chars FROM l GROUP BY 1")
def view_digest(spark, d):
    nodes, e = layered(spark, d)
    n = F.concat(F.lit("n"), text("n_nationkey"))
    view = graph.task_view(nodes, e, table(spark, d, "nation").select(n.alias("task_id"), n.alias("target")))[1]
    return graph.dump_view(view, 600).select("task_id", F.sha2("text", 256).alias("digest"), F.length("text").alias("n_chars"))


@query("view_expand", f"WITH {_FK}, t AS (SELECT 'n' || n_nationkey AS id FROM nation) SELECT id AS task_id, src, dst, type FROM t JOIN e ON type = 'IN' AND (src = id OR dst = id) UNION SELECT 'n' || s_nationkey, src, dst, type FROM supplier JOIN e ON type = 'SITS' AND src = 's' || s_suppkey")
def view_expand(spark, d):
    nodes, e = layered(spark, d)
    n = F.concat(F.lit("n"), text("n_nationkey"))
    view = graph.task_view(nodes, e, table(spark, d, "nation").select(n.alias("task_id"), n.alias("target")), ["IN"])
    seeds = table(spark, d, "supplier").select(F.concat(F.lit("n"), text("s_nationkey")).alias("task_id"), F.concat(F.lit("s"), text("s_suppkey")).alias("target"))
    return graph.expand_view(*view, e, seeds, ["SITS"], 1, "more")[1].select("task_id", "src", "dst", "type")


@query("target_resolution", "WITH q AS (SELECT 'n' || n_nationkey AS q FROM nation) SELECT 'sym:' || s_name AS id, 'symbol' AS how FROM supplier WHERE s_name LIKE '%1'")
def target_resolution(spark, d):
    symbols = table(spark, d, "supplier").where(F.col("s_name").like("%1")).select(F.lit("needleName").alias("name"), F.col("s_name").alias("qualified")).union(table(spark, d, "supplier").select("s_name", "s_name"))
    files = table(spark, d, "part").select(F.concat(F.lit("src/needlename/"), text("p_partkey"), F.lit(".ts")).alias("path"))
    return semantic.resolve_target(symbols, files, "where is needleName used")


@query("feature_seeds", "WITH r AS (SELECT DISTINCT 'file' || (page_id % 9) AS file FROM pages), s AS (SELECT DISTINCT p_brand AS name, 'src/' || p_size || '.ts::' || p_brand AS q FROM part) SELECT 'feature:' || name AS id, name, 'sym:' || q AS symbol, 'symbol' AS seeded_by FROM s UNION ALL SELECT 'feature:SystemBranding', 'SystemBranding', 'file:app/layout.tsx', 'layout'")
def feature_seeds(spark, d):
    p = table(spark, d, "part")
    file = F.concat(F.lit("src/"), text("p_size"), F.lit(".ts"))
    symbols = p.select(F.col("p_brand").alias("name"), F.concat_ws("::", file, "p_brand").alias("qualified"), F.lit("function").alias("kind"), F.lit(True).alias("exported"), file.alias("file")).distinct()
    none = spark.range(0).select(F.lit("").alias("route_path"), F.lit("").alias("file"))
    files = p.select(F.when(F.col("p_size") > 25, "app/layout.tsx").otherwise("lib/layout.tsx").alias("path")).distinct()
    return semantic.seed_features(none, symbols, files)


_CONTEXT = """WITH nt AS (SELECT 'src/' || n_regionkey || '.ts::' || n_name AS q, n_nationkey AS k, 'src/' || n_regionkey || '.ts' AS f FROM nation),
c AS (SELECT DISTINCT 'scope:src/s' || s_suppkey % 7 || '.ts::' || s_name AS scope, 'call' || s_nationkey AS call FROM supplier UNION SELECT 'scope:' || q, 'call' || (k + 1) % 25 FROM nt),
st AS (SELECT DISTINCT scope, 'sym:' || q AS sym FROM c JOIN nt ON call = 'call' || k), t AS (SELECT 'sym:' || q AS target, f FROM nt),
u1 AS (SELECT DISTINCT target, scope AS node FROM t JOIN st ON sym = target),
u2 AS (SELECT DISTINCT target, scope AS node FROM u1 JOIN st ON sym = replace(node, 'scope:', 'sym:') EXCEPT SELECT * FROM u1),
u3 AS (SELECT DISTINCT target, scope AS node FROM u2 JOIN st ON sym = replace(node, 'scope:', 'sym:') EXCEPT SELECT * FROM u1 EXCEPT SELECT * FROM u2),
up AS (SELECT *, 1 AS level FROM u1 UNION ALL SELECT *, 2 FROM u2 UNION ALL SELECT *, 3 FROM u3),
api AS (SELECT DISTINCT 'src/s' || s_suppkey % 7 || '.ts' AS f FROM supplier WHERE s_suppkey % 7 < 3 UNION SELECT 'src/0.ts'),
x AS (SELECT target, 'caller' AS role, node, level FROM up UNION ALL SELECT DISTINCT target, 'callee', sym, 1 FROM t JOIN st ON scope = replace(target, 'sym:', 'scope:')
UNION ALL SELECT target, 'importer', 'file:src/n' || k || '.ts', 1 FROM t JOIN nt USING (f)
UNION ALL SELECT target, 'route', 'api:' || api.f, min(level) FROM (SELECT target, f, 0 AS level FROM t UNION ALL SELECT target, regexp_extract(node, '^scope:(.*)::', 1), level FROM up) h JOIN api USING (f) GROUP BY 1, 3)
"""


def _context(spark, d):
    """Suppliers and nations call nations: scopes in files, of which some are routes; each nation's file imports its region's."""
    nation = table(spark, d, "nation").select(F.concat(F.lit("src/"), text("n_regionkey"), F.lit(".ts::"), "n_name").alias("q"), F.col("n_nationkey").alias("k"), F.concat(F.lit("file:src/"), text("n_regionkey"), F.lit(".ts")).alias("f"))
    supplier = table(spark, d, "supplier").withColumn("f", F.concat(F.lit("src/s"), (F.col("s_suppkey") % 7).cast("string"), F.lit(".ts")))
    call = lambda k: F.concat(F.lit("call"), k.cast("string"))
    edge = lambda df, a, b, kind: df.select(a.alias("src"), b.alias("dst"), F.lit(kind).alias("type"))
    edges = [
        edge(supplier, F.concat(F.lit("scope:"), "f", F.lit("::"), "s_name"), call(F.col("s_nationkey")), "CALLS"), edge(nation, F.concat(F.lit("scope:"), "q"), call((F.col("k") + 1) % 25), "CALLS"), edge(nation, call(F.col("k")), F.concat(F.lit("sym:"), "q"), "REFERENCES"),
        edge(nation, F.concat(F.lit("file:src/n"), text("k"), F.lit(".ts")), F.col("f"), "IMPORTS"), edge(supplier.where("s_suppkey % 7 < 3").select("f").distinct(), F.concat(F.lit("file:"), "f"), F.concat(F.lit("api:"), "f"), "DEFINES"),
        edge(spark.range(1), F.lit("file:src/0.ts"), F.lit("api:src/0.ts"), "DEFINES"),
    ]
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    targets = nation.select(F.concat(F.lit("sym:"), "q").alias("target"))
    return codegraph.context_of(out, targets), targets


@query("context_targets", _CONTEXT + "SELECT target, role, node, level FROM x")
def context_targets(spark, d):
    return _context(spark, d)[0]


@query("context_evidence", _CONTEXT + """SELECT target, regexp_extract(target, '^sym:(.*)::', 1) AS location, count(*) FILTER (role = 'caller' AND level = 1) || ' callers, ' || count(*) FILTER (role = 'callee') || ' callees, ' || count(*) FILTER (role = 'importer') || ' importers' AS payload, 'AST' AS type FROM x GROUP BY 1""")
def context_evidence(spark, d):
    return codegraph.context_evidence(*_context(spark, d)).select("target", "location", "payload", "type")
