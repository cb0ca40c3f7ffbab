"""Attempts, snapshots, patches and their verification, as tables that only grow."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalens.functions import fixed

from .scratch import dealt, written

_PLACED = "struct<at:int,part:int,pos:int,text:string>"


def transition_table(spark: SparkSession) -> DataFrame:
    """prev, next: the steps an attempt may take."""
    rows = [(a, b) for a, b in zip(fixed.CHAIN, fixed.CHAIN[1:], strict=False)] + [(a, f) for f, sources in fixed.FAILURES.items() for a in sources]
    return spark.createDataFrame(rows, "prev string, next string")


def illegal_transitions(history: DataFrame, allowed: DataFrame, key: str = "execution_id", order: str = "ord", status: str = "status") -> DataFrame:
    """key, order, prev, next: steps of a history that the table doesn't allow."""
    w = Window.partitionBy(key).orderBy(order)
    steps = history.select(F.col(key), F.col(order), F.lag(status).over(w).alias("prev"), F.col(status).alias("next")).where("prev IS NOT NULL")
    return steps.join(F.broadcast(allowed), ["prev", "next"], "left_anti").select(key, order, "prev", "next")


def latest(history: DataFrame, key: str = "execution_id", order: str = "ord") -> DataFrame:
    """Each attempt's last row."""
    row = F.max_by(F.struct(*[c for c in history.columns if c != key]), F.col(order)).alias("r")
    return history.groupBy(key).agg(row).select(key, "r.*")


def snapshot_diff(expected: DataFrame, current: DataFrame) -> DataFrame:
    """path, problem (changed, missing, new): where two snapshots (path, hash) differ."""
    e, c = expected.select("path", F.col("hash").alias("e")), current.select("path", F.col("hash").alias("c"))
    problem = F.when(F.col("c").isNull(), "missing").when(F.col("e").isNull(), "new").when(F.col("e") != F.col("c"), "changed")
    return e.join(c, "path", "full_outer").withColumn("problem", problem).where("problem IS NOT NULL").select("path", "problem")


def content_drift(expected: DataFrame, actual: DataFrame, touched: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """path, problem over the files that the patch touches: differs from plan, outside plan (unless deleted), missing."""
    e, a = expected.select("path", F.col("hash").alias("e")), actual.select("path", F.col("hash").alias("a"))
    both = e.join(a, "path", "full_outer").join(touched.select("path"), "path", "left_semi")
    if deleted is not None:
        both = both.join(deleted.select("path").withColumn("_gone", F.lit(True)), "path", "left")
    else:
        both = both.withColumn("_gone", F.lit(None).cast("boolean"))
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull() & F.col("_gone").isNull(), "outside plan").when(F.col("e") != F.col("a"), "differs from plan")
    return both.withColumn("problem", problem).where("problem IS NOT NULL").select("path", "problem")


def fingerprint(head: Column, clean: Column, hashes: Column, tracked: Column) -> Column:
    from stratalens.functions.text import stable_id

    return stable_id(head, clean.cast("string"), F.to_json(hashes), F.to_json(tracked))


def inverse_hunks(hunks: DataFrame) -> DataFrame:
    """Hunks that undo: header ranges swapped, + and - exchanged, context and ``\\`` rows kept."""
    flip = lambda x: F.struct(F.when(x.tag == "+", "-").when(x.tag == "-", "+").otherwise(x.tag).alias("tag"), x.text.alias("text"))
    swapped = {"old_start": "new_start", "old_lines": "new_lines", "new_start": "old_start", "new_lines": "old_lines"}
    return hunks.select(*[F.col(swapped[c]).alias(c) if c in swapped else F.transform("lines", flip).alias("lines") if c == "lines" else F.col(c) for c in hunks.columns])


def patch_text(hunks: DataFrame) -> DataFrame:
    """sha, file, patch, patch_sha256: unified diff text of each file's hunks, last to first line order kept by idx."""
    head = F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_lines", "new_start", "new_lines")
    body = F.concat_ws("\n", head, F.array_join(F.transform("lines", lambda x: F.concat(x.tag, x.text)), "\n"))
    files = hunks.withColumn("_b", body).groupBy("sha", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "_b"))), lambda x: x._b), "\n").alias("b"))
    text = F.concat(F.lit("--- a/"), F.col("file"), F.lit("\n+++ b/"), F.col("file"), F.lit("\n"), F.col("b"), F.lit("\n"))
    return files.select("sha", "file", text.alias("patch"), F.sha2(text, 256).alias("patch_sha256"))


def patch_signature(hunks: DataFrame) -> DataFrame:
    """sha, file, signature: the multiset of changed lines, sorted, so equal patches have equal signatures."""
    rows = hunks.select("sha", "file", F.explode("lines").alias("l")).where("l.tag IN ('+', '-')")
    return rows.groupBy("sha", "file").agg(F.array_sort(F.collect_list(F.struct("l.tag", "l.text"))).alias("signature"))


def missing_hunks(refs: DataFrame, hunks: DataFrame) -> DataFrame:
    """References (sha, file, idx) without a hunk; a patch may only be built when there is none."""
    return refs.join(hunks.select("sha", "file", "idx"), ["sha", "file", "idx"], "left_anti")


def content_hashes(lines: DataFrame) -> DataFrame:
    """path, hash: SHA-256 of each file's lines (path, line_no, text) in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x.text), "\n")
    return lines.groupBy("path").agg(F.sha2(text, 256).alias("hash"))


def actual_patch(before: DataFrame, after: DataFrame) -> DataFrame:
    """file, idx, old_start, old_lines, new_start, new_lines, lines: what changed between two line tables.

    Files of equal hash are left out first; of the others, one at a time, the lines between the common head and tail are
    aligned. A hunk holds removed and added lines only.
    """
    a, b = content_hashes(before).withColumnRenamed("hash", "a"), content_hashes(after).withColumnRenamed("hash", "b")
    changed = a.join(b, "path", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select("path")
    side = lambda df, n: df.join(changed, "path", "left_semi").select("path", "line_no", "text", F.lit(n).alias("side"))

    kind = dict(before.dtypes)["path"]
    # written, since a union of two joins on path would count as dealt by path already, whatever they become at run time
    both = written(side(before, 0).unionByName(side(after, 1)), "sides")

    def hunks(batches):
        path, texts, found = None, ([], []), []

        def put():
            for k, (a, b, c, d) in enumerate(_steps(*texts)):
                found.append((path, k, a + (b > a), b - a, c + (d > c), d - c, [("-", x) for x in texts[0][a:b]] + [("+", x) for x in texts[1][c:d]]))

        def batch(field):
            cols = list(zip(*found, strict=True)) or [()] * 7
            lines = pa.array([[{"tag": t, "text": x} for t, x in ls] for ls in cols[6]], pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string())])))
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], field), *(pa.array(c, pa.int32()) for c in cols[1:6]), lines], names=["file", "idx", "old_start", "old_lines", "new_start", "new_lines", "lines"])

        field = None
        for b in batches:
            field = b.schema.field(0).type
            for p, text, n in zip(*(b.column(c).to_pylist() for c in ("path", "text", "side")), strict=True):
                if p != path:
                    put()
                    path, texts = p, ([], [])
                texts[n].append(text)
            yield batch(field)
        put()
        if found:
            yield batch(field)

    # a file's lines follow each other, so one file is in memory at a time
    rows = both.repartition("path").sortWithinPartitions("path", "side", "line_no")
    return rows.mapInArrow(hunks, f"file {kind}, idx int, old_start int, old_lines int, new_start int, new_lines int, lines array<struct<tag:string,text:string>>")


def _steps(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """Ranges old[a:b] that became new[c:d], without the common head and tail aligned."""
    import difflib

    head = 0
    while head < min(len(old), len(new)) and old[head] == new[head]:
        head += 1
    tail = 0
    while tail < min(len(old), len(new)) - head and old[-1 - tail] == new[-1 - tail]:
        tail += 1
    match = difflib.SequenceMatcher(None, old[head : len(old) - tail], new[head : len(new) - tail], autojunk=False)
    return [(a + head, b + head, c + head, d + head) for op, a, b, c, d in match.get_opcodes() if op != "equal"]


def verify(before: DataFrame, planned: DataFrame, after: DataFrame, status: DataFrame, rolled_back: DataFrame, kept: DataFrame, files: DataFrame, proof: DataFrame | None = None) -> DataFrame:
    """sha, expected, preservation, scope, outside, drift, conflict, tests, evidence, overall: judged by what happened.

    before, planned, after: line tables (path, line_no, text): what the patch was tried on, what it should leave, what it
    left. status (path, status) of the patch's files. rolled_back and kept: hunks (sha, file, lines). files (sha, file): what
    may change. proof (sha, tests, evidence); without it neither holds.

    expected: every rolled-back file did change, and every line that its hunks added is gone. preservation and scope: see
    the faces; a touched file that isn't what was planned is drift and out of scope. A file that no commit
    names counts against each (the first 20 are listed). A conflict in a file of a commit is a failure of its own.
    """
    patch = written(_removed(before, planned, after), "patch")
    rows = files.count() + patch.count() + sum(df.agg(F.sum(F.greatest(F.lit(1), F.size("lines")))).first()[0] or 0 for df in (rolled_back, kept))
    # by file: what happened to the files of each commit
    named = [df.select("sha", "file", F.lit(own).alias("_own")) for df, own in ((rolled_back, True), (files, True), (kept, False))]
    pairs = dealt(reduce(DataFrame.union, named), rows, "file").groupBy("sha", "file").agg(F.bool_or("_own").alias("_own"))
    clashes = dealt(status.where("status = 'CONFLICT'").select(F.col("path").alias("file")), rows, "file").distinct().withColumn("_clash", F.lit(True))
    facts = pairs.join(dealt(patch, rows, "file"), "file", "left").join(clashes, "file", "left")
    loose = dealt(patch.select("file"), rows, "file").join(pairs.select("file"), "file", "left_anti").orderBy("file").limit(20).agg(F.collect_list("file").alias("_loose"))
    # by commit: lines of kept (0), rolled-back (1) and actual (2) hunks and planned files (3), judged by three aggregates
    no = F.lit(False)
    side = lambda df, n, text, *marks: df.select("sha", "file", text.alias("text"), F.lit(n).alias("side"), *[x.alias(c) for x, c in zip(marks or (no, no, no), ("a", "moved", "clash"), strict=True)])
    added = F.explode_outer(F.transform(F.filter("lines", lambda x: x.tag == "+"), lambda x: x.text))
    happened = side(facts, 2, F.explode_outer("removed"), F.col("moved").isNotNull(), F.coalesce("moved", no), F.col("_own") & F.coalesce("_clash", no))
    each = reduce(DataFrame.union, [happened, side(kept, 0, added), side(rolled_back, 1, added), side(files, 3, F.lit(None).cast("string"))])
    rows += patch.agg(F.sum(F.size("removed"))).first()[0] or 0
    marks = [F.bool_or(c).alias(c) for c in ("a", "moved", "clash")]
    count = [F.count_if(F.col("side") == n).alias(c) for n, c in enumerate(("k", "r", "got", "p"))]
    lines = dealt(each, rows, "sha").groupBy("sha", "file", "text").agg(*count, *marks)
    held = F.col("text").isNotNull()
    by_file = lines.groupBy("sha", "file").agg(F.bool_and(~held | (F.col("got") >= F.col("r"))).alias("gone"), F.bool_or(held & (F.col("k") > 0) & (F.col("got") > 0)).alias("lost"), *[F.bool_or(F.col(c) > 0).alias(c) for c in "krp"], *marks)
    listed = lambda x, c: F.array_sort(F.collect_list(F.when(x, F.col("file")))).alias(c)
    k, r, p, touched = (F.col(c) for c in ("k", "r", "p", "a"))
    faces = by_file.groupBy("sha").agg(
        F.bool_or("r").alias("_asked"), F.bool_and(F.col("gone") & ~(r & ~touched)).alias("expected"), (~F.bool_or(k & touched & (~r | F.col("lost")))).alias("preservation"),
        listed(touched & ~p, "outside"), listed(touched & F.col("moved"), "drift"), listed(F.col("clash"), "conflict"),
    ).where("_asked")
    if proof is not None:
        faces = faces.join(dealt(proof.select("sha", "tests", "evidence"), rows, "sha"), "sha", "left")
    else:
        faces = faces.withColumns({"tests": no, "evidence": no})
    faces = faces.crossJoin(F.broadcast(loose))  # one row
    expected = F.col("expected") & (F.size("conflict") == 0)
    scope = (F.size("outside") == 0) & (F.size("drift") == 0) & (F.size("_loose") == 0)
    out = faces.select("sha", expected.alias("expected"), "preservation", scope.alias("scope"), F.concat("outside", "_loose").alias("outside"), "drift", "conflict", F.coalesce("tests", no).alias("tests"), F.coalesce("evidence", no).alias("evidence"))
    return verification(out)


def _removed(before: DataFrame, planned: DataFrame, after: DataFrame) -> DataFrame:
    """file, moved, removed of each file that changed: whether it isn't what was planned, and the lines that ``actual_patch``
    removes. All three tables are dealt by file once."""
    side = lambda df, n: df.select("path", F.struct("line_no", "text").alias("l"), F.lit(n).alias("side"))
    each = side(before, 0).union(side(planned, 1)).union(side(after, 2))
    texts = lambda n, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == n, F.col("l")))), lambda x: x.text).alias(c)
    held = dealt(each, before.count() + planned.count() + after.count(), "path").groupBy("path").agg(texts(0, "b"), texts(1, "p"), texts(2, "a"))
    none = [F.size(c) == 0 for c in "bpa"]
    # a file that the plan deletes may be left
    moved = F.when(none[1], none[0] & ~none[2]).otherwise(F.col("p") != F.col("a"))
    kind = dict(before.dtypes)["path"]

    def steps(batches):
        for x in batches:
            old, new = x.column(2).to_pylist(), x.column(3).to_pylist()
            removed = [[t for a, b, _, _ in _steps(o, n) for t in o[a:b]] for o, n in zip(old, new, strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(removed, pa.list_(pa.string()))], names=["file", "moved", "removed"])

    return held.where(F.col("b") != F.col("a")).select("path", moved.alias("moved"), "b", "a").mapInArrow(steps, f"file {kind}, moved boolean, removed array<string>")


def verification(faces: DataFrame) -> DataFrame:
    """faces (expected, preservation, scope, tests, evidence booleans) with overall VERIFIED, PARTIAL or FAILED."""
    hard = F.col("expected") & F.col("preservation") & F.col("scope")
    return faces.withColumn("overall", F.when(hard & F.col("tests") & F.col("evidence"), "VERIFIED").when(hard, "PARTIAL").otherwise("FAILED"))


def expected_face(rolled_back: DataFrame, actual: DataFrame) -> DataFrame:
    """sha, expected: every line that rolled-back hunks added is among the lines the actual patch removes, per file."""
    added = rolled_back.select("sha", "file", F.explode("lines").alias("l")).where("l.tag = '+'").groupBy("sha", "file", F.col("l.text").alias("text")).agg(F.count("*").alias("want"))
    gone = actual.select("sha", "file", F.explode("lines").alias("l")).where("l.tag = '-'").groupBy("sha", "file", F.col("l.text").alias("text")).agg(F.count("*").alias("got"))
    return added.join(gone, ["sha", "file", "text"], "left").groupBy("sha").agg(F.bool_and(F.coalesce("got", F.lit(0)) >= F.col("want")).alias("expected"))


def preservation_face(kept: DataFrame, rolled_back: DataFrame, actual: DataFrame) -> DataFrame:
    """sha, preservation: the actual patch touches no file that only kept hunks change, and removes no line that a kept hunk
    added in a file that both sides change.

    kept, rolled_back, actual: hunks (sha, file, lines). A commit without kept hunks is preserved.
    """
    texts = lambda tag: F.explode_outer(F.transform(F.filter("lines", lambda x: x.tag == tag), lambda x: x.text)).alias("text")
    side = lambda df, text, n: df.select("sha", "file", text, F.lit(n).alias("side"))
    each = side(kept, texts("+"), 0).union(side(rolled_back, F.lit(None).cast("string").alias("text"), 1)).union(side(actual, texts("-"), 2))
    rows = rolled_back.count() + sum(df.agg(F.sum(F.greatest(F.lit(1), F.size("lines")))).first()[0] or 0 for df in (kept, actual))
    on = [F.bool_or(F.col("side") == n).alias(c) for n, c in enumerate("kra")]
    lines = dealt(each, rows, "sha").groupBy("sha", "file", "text").agg(*on)
    lost = F.bool_or(F.col("k") & F.col("a") & F.col("text").isNotNull()).alias("lost")
    files = lines.groupBy("sha", "file").agg(*[F.bool_or(c).alias(c) for c in "kra"], lost)
    broken = F.col("sha").isNotNull() & F.col("file").isNotNull() & F.col("k") & F.col("a") & (~F.col("r") | F.col("lost"))
    return files.groupBy("sha").agg(F.bool_or("a").alias("a"), F.bool_or(broken).alias("broken")).where("a").select("sha", (~F.col("broken")).alias("preservation"))


def scope_face(actual: DataFrame, planned: DataFrame, drift: DataFrame | None = None) -> DataFrame:
    """sha, scope, outside: whether the actual patch's files (sha, file) are among the planned ones, and which aren't; drift
    (sha, path, problem) fails it as well."""
    beyond = actual.select("sha", "file").distinct().join(planned.select("sha", "file").distinct(), ["sha", "file"], "left_anti")
    listed = beyond.groupBy("sha").agg(F.array_sort(F.collect_set("file")).alias("outside"))
    out = actual.select("sha").distinct().join(listed, "sha", "left")
    if drift is not None:
        out = out.join(drift.select("sha").distinct().withColumn("_drift", F.lit(True)), "sha", "left")
    else:
        out = out.withColumn("_drift", F.lit(None).cast("boolean"))
    return out.select("sha", (F.col("outside").isNull() & F.col("_drift").isNull()).alias("scope"), F.coalesce("outside", F.array().cast("array<string>")).alias("outside"))


def evidence_face(attempts: DataFrame, evidence: DataFrame) -> DataFrame:
    """key columns with evidence: an attempt (sha, evidence_ids, has_patches, has_snapshot) cites evidence, all of it
    registered (id), and has both patches and a snapshot."""
    cited = attempts.select("sha", F.explode("evidence_ids").alias("id"))
    lost = cited.join(evidence.select("id"), "id", "left_anti").select("sha").distinct().withColumn("_lost", F.lit(True))
    whole = (F.coalesce(F.size("evidence_ids"), F.lit(0)) > 0) & F.col("_lost").isNull() & F.col("has_patches") & F.col("has_snapshot")
    return attempts.join(lost, "sha", "left").select("sha", F.coalesce(whole, F.lit(False)).alias("evidence"))


def apply_hunks(lines: DataFrame, hunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A line table (path, line_no, text) after hunks (file, idx, old_start, old_lines, lines), and path, status of each file.

    A hunk's context and removed lines must be what the table holds from old_start on, else its file is in CONFLICT and
    keeps its lines; other files are APPLIED_SANDBOX. A hunk without old lines inserts after old_start, which must be a
    line of the file or its very beginning.
    """
    of = lambda tags: F.filter("lines", lambda x: x.tag.isin(*tags))
    row = lambda at, part, pos, text: F.struct(at.cast("int").alias("at"), F.lit(part).alias("part"), pos.cast("int").alias("pos"), text.cast("string").alias("text"))
    start, zero, none = F.col("old_start"), F.lit(0), F.lit(None)
    # part 0: lines of the table; 1: new lines; 2: lines that a hunk expects; 3: the line an insertion follows; 4: the file has hunks
    expected = F.transform(of(" -"), lambda x, i: row(start + i, 2, i, x.text))
    new = F.transform(of(" +"), lambda x, i: row(start, 1, i, x.text))
    follows = F.when((F.size(of(" -")) == 0) & (start > 0), F.array(row(start, 3, zero, none))).otherwise(F.array().cast(f"array<{_PLACED}>"))
    placed = hunks.select(F.col("file").alias("path"), F.explode(F.concat(expected, new, follows, F.array(row(none, 4, zero, none)))).alias("r")).select("path", "r.*")
    table = lines.select("path", F.col("line_no").cast("int").alias("at"), F.lit(0).alias("part"), F.lit(0).alias("pos"), "text")
    rows = lines.count() + (hunks.agg(F.sum(F.size("lines") + 2)).first()[0] or 0)
    # dealt and sorted once: all windows take the rows as they lie
    each = dealt(table.unionByName(placed), rows, "path").sortWithinPartitions("path", "at", "part", "pos")
    spot, file = Window.partitionBy("path", "at"), Window.partitionBy("path")
    own = F.when(F.col("part") == 0, F.col("text"))
    here, low, high, texts = F.count_if(F.col("part") == 0).over(spot), F.min(own).over(spot), F.max(own).over(spot), F.count(own).over(spot)
    same = F.when(F.col("text").isNull(), texts == 0).otherwise((here > 0) & (texts == here) & (low == F.col("text")) & (high == F.col("text")))
    wrong = F.when(F.col("part") == 2, ~same).when(F.col("part") == 3, here == 0).otherwise(False)
    judged = each.withColumns({"_wrong": wrong, "_covered": F.count_if(F.col("part") == 2).over(spot) > 0}).withColumn("_bad", F.bool_or("_wrong").over(file))
    status = judged.where("part = 4").select("path", F.when(F.col("_bad"), "CONFLICT").otherwise("APPLIED_SANDBOX").alias("status")).distinct()
    left = judged.where("part = 0 AND (_bad OR NOT _covered) OR part = 1 AND NOT _bad")
    return left.withColumn("line_no", F.row_number().over(file.orderBy("at", "part", "pos"))).select("path", "line_no", "text"), status


def prepare(plans: DataFrame, expected: DataFrame, current: DataFrame) -> DataFrame:
    """execution_id, status: PREPARED, or STALE_PLAN where a file of the plan (execution_id, path) is no longer what the
    snapshot it was made on says (path, hash on both sides)."""
    moved = plans.select("execution_id", "path").join(snapshot_diff(expected, current), "path").select("execution_id").distinct().withColumn("_moved", F.lit(True))
    return plans.select("execution_id").distinct().join(moved, "execution_id", "left").select("execution_id", F.when(F.col("_moved"), "STALE_PLAN").otherwise("PREPARED").alias("status"))


def patch_status(refs: DataFrame, hunks: DataFrame) -> DataFrame:
    """sha, status: PATCH_BUILT where all referenced hunks exist, else CONFLICT."""
    lost = missing_hunks(refs, hunks).select("sha").distinct().withColumn("_lost", F.lit(True))
    return refs.select("sha").distinct().join(lost, "sha", "left").select("sha", F.when(F.col("_lost"), "CONFLICT").otherwise("PATCH_BUILT").alias("status"))


def unchanged(expected: DataFrame, current: DataFrame) -> DataFrame:
    """current, checked: reading it fails if a file differs from the expected snapshot (path, hash)."""
    bad = snapshot_diff(expected, current).agg(F.count("*").alias("_n"))
    held = F.when(F.col("_n") > 0, F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(" files changed since the snapshot"))).cast("string")).otherwise(F.col("path"))
    return current.crossJoin(F.broadcast(bad)).withColumn("path", held).drop("_n")  # one row


def attempt_ids(requests: DataFrame) -> DataFrame:
    """requests (seq, sha, ...) with execution_id: the number, the commit's first eight characters and a hash of both."""
    from stratalens.functions.text import stable_id

    return requests.withColumn("execution_id", F.concat_ws("-", F.lpad(F.col("seq").cast("string"), 4, "0"), F.left("sha", F.lit(8)), stable_id("seq", "sha")))


def load_attempts(spark: SparkSession, path: str) -> DataFrame:
    """The latest row of each attempt in a log of JSON lines (execution_id, ord, status, plan, snapshot, patch_sha)."""
    schema = "execution_id string, ord bigint, status string, plan string, snapshot map<string,string>, patch_sha string"
    return latest(spark.read.schema(schema).json(path).where("execution_id IS NOT NULL"))


def validation_status(results: DataFrame) -> DataFrame:
    """execution_id, status, tests: VALIDATED unless a command didn't pass; tests holds only if there was one."""
    bad = F.count_if(F.coalesce("result", F.lit("PASSED")) != "PASSED")
    return results.groupBy("execution_id").agg(F.when(bad > 0, "TEST_FAILED").otherwise("VALIDATED").alias("status"), ((bad == 0) & (F.count("result") > 0)).alias("tests"))


def plan_contract(units: DataFrame) -> DataFrame:
    """unit_id, file, symbols, contract (REVERT or UNCHANGED): what a plan will change and what it must not."""
    own = lambda f: F.filter("symbols", lambda s: F.startswith(s, F.concat(f, F.lit("::"))))
    rows = units.select("unit_id", "action", "symbols", F.explode("files").alias("file"))
    return rows.select("unit_id", "file", own(F.col("file")).alias("symbols"), F.when(F.col("action") == "ROLLBACK", "REVERT").otherwise("UNCHANGED").alias("contract"))
