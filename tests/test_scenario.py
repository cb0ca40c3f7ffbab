"""A small web application with five commits: what the questions must answer by construction."""

import pytest
from pyspark.sql import functions as F

from stratalens.operators import cochange, codegraph, components, evidence, graph, lifecycle, ranges, search, units
from stratalens.plans import tasks
from stratalens.sources.script_facts import facts_of

FILES = {
    "src/app/layout.tsx": "import './globals.css'\nexport const metadata = { title: '园艺手册' }\nexport default function RootLayout({ children }) {\n  return <html><body>{children}</body></html>\n}\n",
    "src/app/login/page.tsx": "import { login } from '@/lib/auth'\nexport default function LoginPage() {\n  const submit = useCallback(async () => {\n    await login('a', 'b')\n  }, [])\n  return <Button onClick={submit}>登录</Button>\n}\n",
    "src/components/Button.tsx": "export const Button = (props) => {\n  return <button {...props} />\n}\n",
    "src/lib/auth.ts": "import { request } from './http'\nexport async function login(account: string, password: string) {\n  if (!account) { throw new Error('no account') }\n  return request('/api/auth/login')\n}\nexport class Session {\n  refresh(token) {\n    return request(token)\n  }\n}\n",
    "src/lib/http.ts": "export function request(url) {\n  return fetch(url)\n}\n",
    "src/lib/drafts.ts": "export async function draftTwice(seed) {\n  return seed + seed\n}\nexport function reviewDraft(seed) {\n  return draftTwice(seed)\n}\n",
    "src/app/api/drafts/route.ts": "import { reviewDraft } from '@/lib/drafts'\nexport async function POST(req) {\n  return reviewDraft(await req.json())\n}\n",
    "src/app/api/auth/login/route.ts": "import { login } from '../../../../lib/auth'\nexport async function POST(req) {\n  return login(req.a, req.b)\n}\n",
    "README.md": "# garden notes\n",
}


def hunk(sha, file, idx, start, lines):
    new = sum(t in " +" for t, _ in lines)
    old = sum(t in " -" for t, _ in lines)
    return sha, file, idx, start, old, start, new, [{"tag": t, "text": x} for t, x in lines]


@pytest.fixture(scope="module")
def repo(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    touched = {"c1": [f for f in FILES if f != "README.md"], "c2": ["src/lib/drafts.ts"], "c3": ["src/app/layout.tsx", "src/lib/auth.ts", "src/app/login/page.tsx"], "c4": ["README.md"]}
    messages = ["begin: garden notes", "feat: a second draft of each note", "mixed: new page title, stricter login account check", "docs: how to plant"]
    commits = spark.createDataFrame([(s, m, k) for k, (s, m) in enumerate(zip(touched, messages, strict=True))], "sha string, subject string, ord int")
    cf = spark.createDataFrame([(s, f) for s, fs in touched.items() for f in fs], "sha string, file string")
    hunks = spark.createDataFrame(
        [
            hunk("c3", "src/app/layout.tsx", 0, 2, [("-", "export const metadata = { title: '旧手册标题' }"), ("+", "export const metadata = { title: '园艺手册' }")]),
            hunk("c3", "src/lib/auth.ts", 0, 2, [(" ", "export async function login(account: string, password: string) {"), ("+", "  if (!account) { throw new Error('no account') }")]),
            hunk("c3", "src/app/login/page.tsx", 0, 4, [("-", "    await login('a')"), ("+", "    await login('a', 'b')")]),
        ],
        "sha string, file string, idx int, old_start int, old_lines int, new_start int, new_lines int, lines array<struct<tag:string,text:string>>",
    )
    return tasks.Repository(spark, files, commits, cf, hunks)


def test_facts():
    rows = list(facts_of("src/lib/auth.ts", FILES["src/lib/auth.ts"]))
    symbols = {(r[2], r[3], r[6]) for r in rows if r[0] == "symbol"}
    assert symbols == {("login", "function", True), ("Session", "class", True), ("refresh", "method", False)}
    calls = {(r[9], r[2]) for r in rows if r[0] == "call"}
    assert ("src/lib/auth.ts::login", "request") in calls and ("src/lib/auth.ts::Session.refresh", "request") in calls
    rows = list(facts_of("p.tsx", FILES["src/app/login/page.tsx"]))
    assert {(r[2], r[3]) for r in rows if r[0] == "symbol"} == {("LoginPage", "component"), ("submit", "arrow_const")}
    assert ("Button" in {r[2] for r in rows if r[0] == "jsx"}) and ("登录" in {r[2] for r in rows if r[0] == "ui"})
    assert [r[8] for r in rows if r[0] == "import"] == [["login"]]
    assert list(facts_of("x.ts", "")) == [] and not [r for r in facts_of("x.ts", "// call(1)\nconst s = 'f(2)'") if r[0] == "call"]


def test_imports_and_endpoints(repo):
    got = {(r.importer, r.specifier): r.source_file for r in repo.facts["imports"].collect()}
    assert got["src/app/login/page.tsx", "@/lib/auth"] == "src/lib/auth.ts"
    assert got["src/app/api/auth/login/route.ts", "../../../../lib/auth"] == "src/lib/auth.ts"
    assert got["src/app/layout.tsx", "./globals.css"] == ""
    assert {(r.route_path, tuple(r.methods)) for r in repo.endpoints.collect()} == {("/api/drafts", ("POST",)), ("/api/auth/login", ("POST",))}


def test_locate(repo):
    lexical = tasks.locate(repo, "手册标题在哪里修改").collect()
    assert lexical[0].path == "src/app/layout.tsx"
    by_graph = tasks.locate(repo, "手册标题在哪里修改", "graph").collect()
    assert by_graph[0].path == "src/app/layout.tsx" and by_graph[0].score > lexical[0].score
    exact = tasks.locate(repo, "where is draftTwice", "structural").collect()
    assert exact[0].path == "src/lib/drafts.ts"
    assert tasks.locate(repo, "的").count() == 0


def test_graph_adds_places(repo):
    """A symbol's file that no line names, and a file that only shows a string."""
    by_graph = {r.path: r.score for r in tasks.locate(repo, "who uses draftTwice in 手册", "graph").collect()}
    assert by_graph["src/lib/drafts.ts"] > 0
    few = {r.path for r in tasks.locate(repo, "登录", "lexical").collect()}
    assert few <= {r.path for r in tasks.locate(repo, "登录", "graph").collect()}


def test_impact_history_paths_and_fallback(repo, spark):
    rows = tasks.impact(repo, "login").collect()
    buckets = {r.bucket for r in rows}
    assert {"callers", "importing_files", "routes", "cochanged", "path"} <= buckets
    path = next(r for r in rows if r.bucket == "path")
    assert path.file == "src/app/api/auth/login/route.ts" and path.name.endswith("sym:src/lib/auth.ts::login")
    assert "src/app/login/page.tsx" in {r.file for r in rows if r.bucket == "cochanged"}
    assert {r.bucket for r in tasks.impact(repo, "login", "structural").collect()}.isdisjoint({"cochanged", "path"})
    repo.extra["blame"] = spark.createDataFrame([("src/lib/auth.ts", 3, "c3"), ("src/lib/auth.ts", 2, "c1"), ("src/lib/auth.ts", 9, "c9")], "file string, line_no int, sha string")
    assert {r.name for r in tasks.impact(repo, "login").collect() if r.bucket == "blamed"} == {"c1", "c3"}
    del repo.extra["blame"]
    guess = {(r.bucket, r.file) for r in tasks.impact(repo, "useCallback").collect()}
    assert guess == {("call", "src/app/login/page.tsx")}


def test_app_views(repo):
    got = {(r.role, r.qualified) for r in codegraph.app_views(repo.facts["symbols"], repo.files).collect()}
    assert got == {("page", "src/app/login/page.tsx::LoginPage"), ("layout", "src/app/layout.tsx::RootLayout")}


def test_impact(repo):
    rows = tasks.impact(repo, "draftTwice").collect()
    assert ("callers", "src/lib/drafts.ts") in {(r.bucket, r.file) for r in rows}
    assert ("indirectly_affected", "src/app/api/drafts/route.ts") in {(r.bucket, r.file) for r in rows}
    assert ("routes", "/api/drafts") in {(r.bucket, r.file) for r in rows}
    rows = tasks.impact_of_query(repo, "Button?").collect()
    assert ("callers", "src/app/login/page.tsx") in {(r.bucket, r.file) for r in rows}


def test_rollback_splits_the_mixed_commit(repo):
    out = tasks.rollback(repo, "登录坏了，保留标题", "c3")
    got = {(r.label, tuple(r.files), r.action) for r in out["units"].collect()}
    assert got == {("auth", ("src/app/login/page.tsx", "src/lib/auth.ts"), "ROLLBACK"), ("title", ("src/app/layout.tsx",), "KEEP")}
    assert out["risk"].first().risk == 0.0
    passed = repo.spark.createDataFrame([("e", "PASSED")], "execution_id string, result string")
    snapshot = lifecycle.content_hashes(search.lines(repo.files).select("path", "line_no", "text"))
    ids = repo.spark.createDataFrame([("c3", "ev:1"), ("c3", "ev:2")], "sha string, id string")
    full = {"results": passed, "snapshot": snapshot, "cited": ids, "registered": ids.select("id")}
    done = tasks.execute(repo, out["units"], **full)
    assert done["missing"].count() == 0 and done["verification"].first().overall == "VERIFIED" and done["status"].first().status == "PATCH_BUILT"
    assert {r.path: r.status for r in done["applied"].collect()} == {"src/lib/auth.ts": "APPLIED_SANDBOX", "src/app/login/page.tsx": "APPLIED_SANDBOX"}
    after = [r.text for r in done["after"].where("path = 'src/app/login/page.tsx'").orderBy("line_no").collect()]
    assert after[3] == "    await login('a')" and len(after) == len(FILES["src/app/login/page.tsx"].split("\n"))
    assert out["coupling_check"].first().asDict() == {"rollback_files": 2, "keep_files": 1, "couplings": 0}
    assert {r.side: r.domains for r in out["hints"].collect()} == {"problem": ["auth"], "keep": ["title"]}
    judged = out["units"]
    moved = tasks.Repository(repo.spark, repo.files.withColumn("content", F.replace("content", F.lit("no account"), F.lit("none"))), repo.commits, repo.commit_files, repo.hunks)
    clash = tasks.execute(moved, judged, **(full | {"snapshot": None}))
    assert {r.path: r.status for r in clash["applied"].collect()}["src/lib/auth.ts"] == "CONFLICT" and clash["status"].first().status == "CONFLICT"
    got = clash["verification"].first()
    assert got.conflict == ["src/lib/auth.ts"] and not got.expected and got.overall == "FAILED"
    stale = tasks.execute(moved, judged.withColumn("files", F.array(F.lit("src/lib/auth.ts"))), **(full | {"cited": None}))
    assert stale["status"].first().status == "STALE_PLAN"
    got = stale["verification"].first()
    assert got.overall == "FAILED" and not got.evidence
    assert any("-  if (!account)" in r.patch for r in done["patch"].collect())
    assert {r.file for r in out["contract"].where("contract = 'REVERT'").collect()} == {"src/app/login/page.tsx", "src/lib/auth.ts"}


def test_history_and_orchestrate(repo):
    assert [r.sha for r in tasks.history(repo, ["login"]).collect()] == ["c3"]
    out = tasks.orchestrate(repo, "登录 login 坏了", "标题")
    sides = {r.unit_id: r.side for r in out["sides"].collect()}
    assert sorted(sides.values()) == ["keep", "problem"]
    gate = out["gate"].first()
    assert gate.recommendation in ("PASS", "HUMAN_REVIEW", "BLOCK") and gate.invalid_graph_paths >= 0 and out["decisions"].first().category == "policy_gate"
    assert out["view_nodes"].count() > 0
    f = repo.spark.createDataFrame([("f1", ["nowhere"], "login broke"), ("f2", ["x"], "title stays")], "finding_id string, evidence_ids array<string>, statement string")
    rows = repo.spark.createDataFrame([("ast", "t", "l", 0)], "type string, target string, location string, ord int")
    known = evidence.register_evidence(rows).first().id
    f = f.withColumn("evidence_ids", F.when(F.col("finding_id") == "f2", F.array(F.lit(known))).otherwise(F.col("evidence_ids")))
    failed = repo.spark.createDataFrame([("e", "FAILED"), ("e", None)], "execution_id string, result string")
    gate = tasks.orchestrate(repo, "登录 login 坏了", "标题", f, rows, failed)["gate"].first()
    assert gate.unsupported_findings == 1 and gate.unresolved_test_failures == 1 and gate.action != "PASS"
    all_ = tasks.compound(repo, "登录 login 坏了", "标题", f, rows)
    assert all_["commits"].first().sha == "c3" and all_["verified_fraction"].first()[0] in (0.0, 0.5)


def test_graph(repo):
    nodes, edges = repo.graph
    kinds = {r.type: r["count"] for r in nodes.groupBy("type").count().collect()}
    assert kinds["File"] == len(FILES) and kinds["APIEndpoint"] == 2 and kinds["Commit"] == 4 and kinds["Repository"] == 1
    types = {r.type for r in edges.select("type").distinct().collect()}
    assert {"CONTAINS", "DEFINES", "IMPORTS", "CALLS", "REFERENCES", "MODIFIES", "CO_CHANGED_WITH"} <= types
    two = repo.pairs.where("a = 'src/app/layout.tsx' AND b = 'src/lib/auth.ts'").first()
    assert two.n >= 2
    n, e = graph.change_graph(repo.units, repo.commit_files)
    assert n.where("type = 'ChangeUnit'").count() == 2 and e.where("type = 'INTRODUCED_BY'").count() == 2


def test_inverse_is_an_involution(repo):
    twice = lifecycle.inverse_hunks(lifecycle.inverse_hunks(repo.hunks))
    assert twice.exceptAll(repo.hunks).count() == 0


def test_evaluate(spark):
    pred = spark.createDataFrame([("t", "lexical", "a"), ("t", "lexical", "b"), ("u", "graph", "x")], "task_id string, mode string, item string")
    gold = spark.createDataFrame([("t", "a"), ("u", "y")], "task_id string, item string")
    got = {r.mode: (r.precision, r.recall) for r in tasks.evaluate(pred, gold, spark.createDataFrame([("t", "locate"), ("u", "locate")], "task_id string, task_type string")).collect()}
    assert got == {"lexical": (0.5, 1.0), "graph": (0.0, 0.0)}
    runs = spark.createDataFrame([("t", "lexical", None), ("u", "lexical", "broke"), ("u", "graph", None)], "task_id string, mode string, error string")
    all_ = {r.mode: (r.precision, r.runs, r.errors) for r in tasks.evaluate(pred, gold, spark.createDataFrame([("t", "locate"), ("u", "locate")], "task_id string, task_type string"), runs).collect()}
    assert all_ == {"lexical": (0.25, 2, 1), "graph": (0.0, 1, 0)}


def test_components_match_union_find(spark):
    import random

    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges[:-1]:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "sha string, file string")
    assert cochange.cochange_pairs(empty).count() == 0
    one = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), (None, "y")], "sha string, file string")
    assert cochange.cochange_pairs(one).count() == 0
    pts = spark.createDataFrame([("f", 5)], "file string, line int")
    iv = spark.createDataFrame([("f", 1, 9, "wide", 0), ("f", 4, 6, "a", 1), ("f", 4, 6, "b", 2)], "file string, line_start int, line_end int, name string, ord int")
    assert ranges.innermost(pts, iv, ["file"], "line", "line_start", "line_end", ["ord"], ["file", "line"]).first().name == "a"
    assert units.text_domains("") == [] and units.text_domains("登录坏了") == ["auth"]
