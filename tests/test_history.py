import subprocess

from stratalens.sources import history as H

DIFF = """diff --git a/a.ts b/a.ts
--- a/a.ts
+++ b/a.ts
@@ -1,2 +1,3 @@ ctx
 one
--- two
+++ two
+three
\\ No newline at end of file
diff --git a/old.ts b/new.ts
rename from old.ts
rename to new.ts
diff --git a/gone.ts b/gone.ts
deleted file mode 100644
--- a/gone.ts
+++ /dev/null
@@ -1 +0,0 @@
-x
"""


def test_hunks():
    rows = list(H.hunks_of(DIFF))
    assert rows[0][:7] == ("a.ts", 0, 1, 2, 1, 3, "ctx")
    assert rows[0][7] == [(" ", "one"), ("-", "-- two"), ("+", "++ two"), ("+", "three"), ("\\", " No newline at end of file")]
    assert rows[1][0] == "new.ts" and rows[1][1] is None and rows[1][8:] == ("renamed", "old.ts")
    assert rows[2][0] == "gone.ts" and rows[2][8] == "deleted" and rows[2][5] == 0


def git_repo(at, *steps):
    """A repository whose commits write the given files, one after another; returns a function that runs git in it."""
    at.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(at), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True).stdout
    run("init", "-q", "-b", "main")
    for k, files in enumerate(steps):
        for name, text in files.items():
            (at / name).parent.mkdir(parents=True, exist_ok=True)
            (at / name).write_text(text)
        run("add", ".")
        run("commit", "-qm", f"step {k}")
    return run


def test_partitions_filters_roots_and_state(spark, tmp_path):
    run = git_repo(tmp_path / "r", {"a.ts": "1\n"}, {"b.ts": "\x1e%H\x1f\n"}, {"a.ts": "2\n", "b.ts": "3\n"}, {"c.ts": "x\n"})
    shas = run("log", "--format=%H").split()
    run("checkout", "-qb", "side", "HEAD~1")
    (tmp_path / "r" / "d.ts").write_text("side\n")
    run("add", ".")
    run("commit", "-qm", "on the side")
    run("checkout", "-q", "main")
    run("merge", "-q", "--no-edit", "side")
    spark.dataSource.register(H.HistorySource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda **o: spark.read.format("history").options(path=str(tmp_path / "r"), batch=2, pushdown="true", **o).load()
        log = read()
        assert [r.sha for r in log.orderBy("ord").collect()] == run("log", "--format=%H").split() and log.rdd.getNumPartitions() == 3
        one = log.where(log.sha == shas[1])
        assert one.rdd.getNumPartitions() == 1 and [r.subject for r in one.collect()] == ["step 2"]
        assert {r.subject for r in log.where(log.sha.isin(shas[0], shas[3])).collect()} == {"step 3", "step 0"}
        said = log.where(log.subject.contains("the side"))
        assert said.rdd.getNumPartitions() == 1 and [r.files for r in said.collect()] == [["d.ts"]]
        assert log.where(log.subject.contains("step") & log.subject.contains("1")).count() == 1
        assert {r.subject for r in read(file="b.ts").collect()} == {"step 1", "step 2"}
        diffs = {r.sha: r.diff for r in read(mode="diff").collect()}
        assert len(diffs) == 6 and "+1" in diffs[shas[3]] and "new file" in diffs[shas[3]]  # a first commit
        hunks = H.parse_diffs(read(mode="diff")).collect()
        assert {h.file for h in hunks if h.sha == run("rev-parse", "main").strip()} == {"d.ts"}  # a merge against its first parent
        assert {h.file for h in hunks if h.sha == shas[1]} == {"a.ts", "b.ts"}
        (tmp_path / "r" / "new.ts").write_text("")
        state = [(r.name, r.value) for r in read(mode="state", ref="side").collect()]
        assert state == [("is_repo", "true"), ("head", run("rev-parse", "HEAD").strip()), ("ref", run("rev-parse", "side").strip()), ("status", "?? new.ts")]
        (tmp_path / "none").mkdir()
        assert [tuple(r) for r in spark.read.format("history").options(path=str(tmp_path / "none"), mode="state").load().collect()] == [("is_repo", "false")]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_source_and_blame(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True, text=True).stdout
    run("init", "-q")
    for k in range(3):
        (repo / "f.txt").write_text("l1\n" * (k + 1))
        run("add", ".")
        run("commit", "-qm", f"commit {k}")
    spark.dataSource.register(H.HistorySource)
    log = spark.read.format("history").option("path", str(repo)).option("batch", 2).load()
    assert [r.subject for r in log.orderBy("ord").collect()] == ["commit 2", "commit 1", "commit 0"]
    assert log.first().files == ["f.txt"]
    assert spark.read.format("history").option("path", str(repo)).option("grep", "commit 1").load().count() == 1
    diffs = spark.read.format("history").option("path", str(repo)).option("mode", "diff").load()
    hunks = H.parse_diffs(diffs).collect()
    assert len(hunks) == 3 and all(h.lines[-1].tag == "+" for h in hunks)
    raw = spark.createDataFrame([(x,) for x in run("blame", "--porcelain", "f.txt").split("\n")], "value string")
    assert H.parse_blame(raw).count() == 3 and H.parse_blame(raw, first=2, last=2).count() == 1
    text = spark.createDataFrame([(run("log", f"--format={H._FORMAT}", "--name-only"),)], "value string")
    parsed = H.parse_log(text).orderBy("ord").collect()
    assert [p.subject for p in parsed] == ["commit 2", "commit 1", "commit 0"] and parsed[0].files == ["f.txt"]
    assert parsed and spark.createDataFrame([(parsed[0].date_raw,)], "d string").select(H.commit_time("d")).first()[0] is not None
