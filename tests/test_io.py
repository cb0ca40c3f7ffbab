"""Folders, task files, policy files, sinks, registers and rules over small tables."""

import json

import pytest
from pyspark.sql import functions as F

from stratalens import sinks
from stratalens.operators import codegraph, evidence, graph, ledger, lifecycle, policy, search, semantic
from stratalens.sources import files as S


def test_folder_scan(spark, tmp_path):
    root = tmp_path / "tree"
    for name, body in {"src/a.ts": b"export const a = 1\n", "src/bad.ts": b"x\xff\n", "docs/n.md": b"# n\n", "node_modules/p/i.ts": b"no", "src/big.ts": b"x" * 3_000_000, "img.png": b"\x89PNG"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    found = {r.path: r for r in S.files(spark, str(root)).collect()}
    assert {"src/a.ts", "src/bad.ts", "docs/n.md"} <= set(found) and not {"node_modules/p/i.ts", "img.png"} & set(found)
    assert found["src/a.ts"].content == "export const a = 1\n" and found["src/a.ts"].suffix == ".ts" and "\ufffd" in found["src/bad.ts"].content
    code = {r.path for r in S.files(spark, str(root), code_only=True).collect()}
    assert "src/a.ts" in code and "docs/n.md" not in code and "src/big.ts" not in code
    before = S.snapshot(S.files(spark, str(root)))
    assert lifecycle.unchanged(before, before).count() == len(found)
    after = before.withColumn("hash", F.when(F.col("path") == "src/a.ts", "0").otherwise(F.col("hash")))
    with pytest.raises(Exception, match="changed since"):
        lifecycle.unchanged(before, after).collect()


def test_task_files(spark, tmp_path):
    p = tmp_path / "tasks.jsonl"
    p.write_text('// a comment\n{"id":"t1","task_type":"locate","gold":{"files":"a"}}\n\n# more\n{"id":"t2","task_type":"impact","gold":{}}\n{"id":"t3","task_type":"other","gold":{}}\n')
    schema = "id string, task_type string, gold map<string,string>"
    rows = S.jsonl_tasks(spark, str(p), schema)
    assert rows.count() == 3
    wrong = {r.id: r.missing for r in S.task_violations(rows, {"locate": ["files"], "impact": ["callers"]}).collect()}
    assert wrong == {"t2": ["callers"], "t3": None}
    p.write_text('{"id":"t1"}\n{"id":"t1"}\n')
    with pytest.raises(ValueError, match="repeated id"):
        S.jsonl_tasks(spark, str(p), schema)


def test_policy_files():
    text = """
# gates
execution:
  enabled: true   # on
  limits:
    files: 12
    share: 0.5
  note: "a: b"
name: plain text
other:
  - ignored
"""
    got = S.load_policy(text, {"execution": {"enabled": False, "limits": {"files": 1, "lines": 9}, "keep": [1]}, "name": "x", "rest": {"a": 1}})
    assert got["execution"]["enabled"] is True and got["execution"]["limits"] == {"files": 12, "lines": 9, "share": 0.5} and got["execution"]["keep"] == [1]
    assert got["name"] == "plain text" and got["rest"] == {"a": 1} and "other" not in got
    base = {"a": {"b": 1}}
    assert S.load_policy(None, base) == base and S.load_policy("a:\n  b: -3\n  c: 'q'", base) == {"a": {"b": -3, "c": "q"}} and base == {"a": {"b": 1}}
    assert S.load_policy("a: 5", base) == {"a": 5} and S.load_policy("a:\n  b:\n    c: off", base) == {"a": {"b": {"c": "off"}}}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    sinks.write_json(df, str(tmp_path / "j"), pretty=False)
    assert sorted(json.loads(r.value)["n"] for r in spark.read.text(str(tmp_path / "j")).collect()) == [1, 2]
    nodes = spark.createDataFrame([("x", "code"), ("y", "change")], "id string, layer string")
    edges = spark.createDataFrame([("x", "y", "code")], "src string, dst string, layer string")
    sinks.write_graph(nodes, edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).where("layer = 'code'").first().id == "x"
    for k in range(2):
        sinks.append_log(df.withColumn("run", F.lit(k)), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    sinks.write_patches(df, str(tmp_path / "p"), "proposed")
    assert spark.read.parquet(str(tmp_path / "p")).first().role == "proposed"
    assert sinks.report(df, "T").startswith("# T\n\n| k | n |") and "| b | 2 |" in sinks.report(df, "T")


def test_attempt_logs(spark, tmp_path):
    rows = [{"execution_id": "e1", "ord": 1, "status": "CREATED", "snapshot": {"a": "h"}}, {"execution_id": "e1", "ord": 2, "status": "PREPARED"}, {"execution_id": "e2", "ord": 1, "status": "CREATED", "extra": 5}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    got = {r.execution_id: r.status for r in lifecycle.load_attempts(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got == {"e1": "PREPARED", "e2": "CREATED"}
    ids = [r.execution_id for r in lifecycle.attempt_ids(spark.createDataFrame([(1, "abcdef0123456789"), (2, "abcdef0123456789")], "seq int, sha string")).collect()]
    assert ids[0].startswith("0001-abcdef01-") and len(set(ids)) == 2
    h = lambda v: F.lit(v)
    one = spark.range(1).select(lifecycle.fingerprint(h("sha"), F.lit(True), F.create_map(h("a"), h("1")), F.array(h("a"))).alias("x"), lifecycle.fingerprint(h("sha"), F.lit(False), F.create_map(h("a"), h("1")), F.array(h("a"))).alias("y")).first()
    assert one.x != one.y


def test_strict_transitions(spark):
    f = spark.createDataFrame([("f1", ["e"], "proposed")], "finding_id string, evidence_ids array<string>, status string")
    e = spark.createDataFrame([("e",)], "id string")
    none = spark.createDataFrame([], "a string, b string")
    ok = evidence.transition_findings(f, spark.createDataFrame([("f1", "verified")], "finding_id string, status string"), e, none, strict=True).first()
    assert ok.status == "verified" and ok.error is None
    with pytest.raises(Exception, match="unresolved conflict"):
        evidence.transition_findings(f, spark.createDataFrame([("f1", "verified")], "finding_id string, status string"), e, spark.createDataFrame([("f0", "f1")], "a string, b string"), strict=True).collect()


def test_views(spark):
    edges = spark.createDataFrame([("a", "b", "X"), ("b", "c", "Y"), ("c", "d", "X")], "src string, dst string, type string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    n, e = graph.task_view(nodes, edges, spark.createDataFrame([("t", "a"), ("t", "zz")], "task_id string, target string"))
    assert {r.id for r in n.collect()} == {"a", "b"} and e.count() == 1
    n, e, audit = graph.expand_view(n, e, edges, spark.createDataFrame([("t", "b")], "task_id string, target string"), ["Y"], 1, "asked")
    assert {r.id for r in n.collect()} == {"a", "b", "c"} and e.count() == 2 and audit.first().trigger == "asked"
    assert graph.dump_view(e, 12).first().text == "a -X-> b\nb -"


def test_contexts_and_targets(spark):
    edges = spark.createDataFrame([("scope:f.ts::g", "callname:h", "CALLS"), ("callname:h", "sym:f.ts::h", "REFERENCES"), ("scope:f.ts::k", "callname:g", "CALLS"), ("callname:g", "sym:f.ts::g", "REFERENCES"), ("file:m.ts", "file:f.ts", "IMPORTS")], "src string, dst string, type string")
    got = {(r.role, r.node, r.level) for r in codegraph.context_of(edges, spark.createDataFrame([("sym:f.ts::h",)], "target string")).collect()}
    assert got == {("caller", "scope:f.ts::g", 1), ("caller", "scope:f.ts::k", 2), ("importer", "file:m.ts", 1)}
    got = {(r.role, r.node) for r in codegraph.context_of(edges, spark.createDataFrame([("sym:f.ts::g",)], "target string")).collect()}
    assert ("callee", "sym:f.ts::h") in got
    symbols = spark.createDataFrame([("openGate", "a.ts::openGate")], "name string, qualified string")
    fs = spark.createDataFrame([("src/gateway.ts",), ("src/x.ts",)], "path string")
    assert [(r.id, r.how) for r in semantic.resolve_target(symbols, fs, "see openGate now").collect()] == [("sym:a.ts::openGate", "symbol")]
    assert [(r.id, r.how) for r in semantic.resolve_target(symbols, fs, "look at gateway.ts").collect()] == [("file:src/gateway.ts", "file")]
    assert semantic.resolve_target(symbols, fs, "nothing here").count() == 0


def test_budgets_and_guards(spark):
    items = spark.createDataFrame([(1, 5), (2, 5), (3, 1)], "k int, n int")
    assert [r.k for r in search.context_budget(items, "n", ["k"], 9).collect()] == [1]
    argv = spark.createDataFrame([(["log"],), (["push"],), ([],), (None,)], "a array<string>")
    assert [r[0] for r in argv.select(policy.allowed_git(F.col("a"))).collect()] == [True, False, False, False]
    assert [r[0] for r in argv.select(policy.allowed_git(F.col("a"), sandbox=True)).collect()] == [False] * 4
    names = spark.createDataFrame([("sym:a/b.ts::X.y",), ("file:c.ts",), ("api:r.ts",), ("zz",)], "n string")
    assert [r[0] for r in names.select(ledger.file_of(F.col("n"))).collect()] == ["a/b.ts", "c.ts", "r.ts", None]
