"""A table of tasks against one query at a time."""

import pytest
from pyspark.sql import functions as F

from stratalens.functions.text import query_terms
from stratalens.operators import batch_search, search
from stratalens.plans import batch, tasks

from .test_scenario import repo  # noqa: F401  the scenario's code base

QUERIES = ["手册标题在哪里修改", "where is draftTwice", "who uses draftTwice in 手册", "登录", "的", "login Session request"]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(f"l{k}", "locate", q, None) for k, q in enumerate(QUERIES)]
    rows += [("i1", "impact", "what breaks if draftTwice changes", None), ("i2", "impact", "useCallback", None), ("r1", "rollback", "登录坏了，保留标题", "c3")]
    rows += [("e1", "locate", " ", None), ("e2", "guess", "login", None), ("e3", "rollback", "登录坏了", None), ("e4", "impact", "的", None), ("e5", None, None, None)]
    return spark.createDataFrame(rows, "task_id string, task_type string, query string, commit string")


def test_terms_are_rows(spark, table):
    got = {}
    for r in batch_search.task_terms(table).orderBy("task_id", "ord").collect():
        got.setdefault(r.task_id, []).append((r.term, r.origin))
    assert got == {r.task_id: query_terms(r.query) for r in table.collect() if r.query and query_terms(r.query)}


def test_matches_equal_those_of_single_queries(spark):
    lines = ["const Heat = heat(x)", "HEAT-wave preheat heat", "été ÉTÉS été", "İstanbul heat", "标题 heat 标题栏", "", "x.heat_y heat2", "a$b $b", "ẞtraße STRASSE"]
    files = spark.createDataFrame([("f.ts", "\n".join(lines)), ("g/heat.ts", None)], "path string, content string")
    sets = [[("heat", "en:heat"), ("wave", "en:wave")], [("标题", "cjk:标题"), ("heat", "en:heat")], [("été", "en:été")], [("$b", "en:$b")], [("istanbul", "en:i"), ("strasse", "en:s")]]
    terms = spark.createDataFrame([(k, i, t, o) for k, ts in enumerate(sets) for i, (t, o) in enumerate(ts)], "task_id int, ord int, term string, origin string")
    for block in (100, 1):
        found = batch_search.matches(search.lines(files), batch_search.keyed(terms), block)
        for k, ts in enumerate(sets):
            want = {tuple(r) for r in search.matches(search.lines(files), ts).collect()}
            assert {tuple(r)[1:] for r in found.where(F.col("task_id") == k).collect()} == want, ts


def test_located_like_one_at_a_time(repo, table):  # noqa: F811
    got = {}
    for r in batch.locate_all(repo, table.where("task_type = 'locate'")).collect():
        got.setdefault((r.task_id, r.mode), set()).add((r.path, r.line_start, r.line_end, r.symbol, r.score))
    for k in (0, 2, 5):
        for mode in tasks.MODES:
            want = {(r.path, r.line_start, r.line_end, r.symbol, r.score) for r in tasks.locate(repo, QUERIES[k], mode).collect()}
            assert got.get((f"l{k}", mode), set()) == want, (QUERIES[k], mode)


def test_runs_and_errors(repo, table, spark):  # noqa: F811
    done = batch.run_tasks(repo, table)
    runs = {(r.task_id, r.mode): r.error for r in done["runs"].collect()}
    assert len(runs) == 4 * table.count() and {t for (t, _), e in runs.items() if e} == {"e1", "e2", "e3", "e4", "e5"}
    assert runs["e2", "graph"] == "unknown task type: guess" and runs["e4", "lexical"] == "the query names no symbol" and "commit" in runs["e3", "graph"]
    found = {}
    for r in done["predictions"].collect():
        found.setdefault((r.task_id, r.mode), set()).add(r.item)
    assert found["r1", "graph"] == {"src/lib/auth.ts", "src/app/login/page.tsx"}
    assert {"src/lib/drafts.ts", "src/app/api/drafts/route.ts"} <= found["i1", "structural"] and found["i2", "lexical"] == {"src/app/login/page.tsx"}
    gold = spark.createDataFrame([("r1", "src/lib/auth.ts"), ("r1", "src/lib/none.ts"), ("e1", "x"), ("l0", "src/app/layout.tsx")], "task_id string, item string")
    scored = {(r.task_id, r.mode): r for r in batch.scored_runs(done, gold).collect()}
    assert (scored["r1", "graph"].precision, scored["r1", "graph"].recall) == (0.5, 0.5) and scored["e1", "graph"].f1 == 0.0 and scored["i1", "graph"].f1 is None
    assert scored["l0", "lexical"].recall == 1.0
    means = {(r.task_type, r.mode): r for r in batch.report(batch.scored_runs(done, gold)).collect()}
    assert (means["locate", "graph"].runs, means["locate", "graph"].scored, means["locate", "graph"].errors) == (7, 2, 1)
