"""Patches judged by what they did, face by face, and the line tables behind it."""

import difflib
import random

from stratalens.operators import lifecycle

LINES, STATUS = "path string, line_no int, text string", "path string, status string"
HUNKS = "sha string, file string, idx int, old_start int, old_lines int, new_start int, new_lines int, lines array<struct<tag:string,text:string>>"


def table(spark, files):
    return spark.createDataFrame([(p, k, t) for p, ts in files.items() for k, t in enumerate(ts, 1)], LINES)


BEFORE = {"a.ts": ["one", "bad", "two", "kept"], "b.ts": ["x", "gone later"], "k.ts": ["kept only"], "r.ts": ["left", "right"]}
PLANNED = BEFORE | {"a.ts": ["one", "good", "two", "kept"], "r.ts": ["left", "middle", "right"]}
FORWARD = [("c", "a.ts", 0, 2, 1, 2, 1, [("-", "good"), ("+", "bad")]), ("c", "r.ts", 0, 2, 1, 2, 0, [("-", "middle")])]
KEPT = [("c", "a.ts", 1, 3, 0, 4, 1, [("+", "kept")]), ("c", "k.ts", 0, 0, 0, 1, 1, [("+", "kept only")])]
CASES = {
    "as planned": (PLANNED, {}, (True, True, True, True, True, "VERIFIED")),
    "nothing done": (BEFORE, {}, (False, True, True, True, True, "FAILED")),
    "one file left as it was": (PLANNED | {"r.ts": BEFORE["r.ts"]}, {}, (False, True, True, True, True, "FAILED")),
    "a kept line gone": (PLANNED | {"a.ts": ["one", "good", "two"]}, {}, (True, False, False, True, True, "FAILED")),
    "a kept file touched": (PLANNED | {"k.ts": []}, {}, (True, False, False, True, True, "FAILED")),
    "not as planned": (PLANNED | {"a.ts": ["ONE", "good", "two", "kept"]}, {}, (True, True, False, True, True, "FAILED")),
    "another file": (PLANNED | {"new.ts": ["n"]}, {}, (True, True, False, True, True, "FAILED")),
    "conflict": (PLANNED, {"status": [("a.ts", "CONFLICT"), ("r.ts", "APPLIED_SANDBOX")]}, (False, True, True, True, True, "FAILED")),
    "no tests": (PLANNED, {"proof": [("c", False, True)]}, (True, True, True, False, True, "PARTIAL")),
    "no evidence": (PLANNED, {"proof": [("c", True, False)]}, (True, True, True, True, False, "PARTIAL")),
    "no proof": (PLANNED, {"proof": []}, (True, True, True, False, False, "PARTIAL")),
}


def test_each_face_fails_on_its_own(spark):
    """Every case is a commit of its own, its files in a folder of its own; the one that touches an unnamed file is alone."""
    for some in (["another file"], [c for c in CASES if c != "another file"]):
        at = lambda files: {f"{c}/{p}": ts for c in some for p, ts in (files(c) if callable(files) else files).items()}
        named = lambda rows: [(c, f"{c}/{r[1]}", *r[2:]) for c in some for r in rows]
        status = [(f"{c}/{p}", s) for c in some for p, s in CASES[c][1].get("status", [("a.ts", "APPLIED_SANDBOX"), ("r.ts", "APPLIED_SANDBOX")])]
        proof = [(c, *r[1:]) for c in some for r in CASES[c][1].get("proof", [("c", True, True)])]
        got = lifecycle.verify(
            table(spark, at(BEFORE)), table(spark, at(PLANNED)), table(spark, at(lambda c: CASES[c][0])), spark.createDataFrame(status, STATUS), spark.createDataFrame(named(FORWARD), HUNKS), spark.createDataFrame(named(KEPT), HUNKS),
            spark.createDataFrame(named([("c", "a.ts"), ("c", "r.ts")]), "sha string, file string"), spark.createDataFrame(proof, "sha string, tests boolean, evidence boolean"),
        )
        assert {r.sha: (r.expected, r.preservation, r.scope, r.tests, r.evidence, r.overall) for r in got.collect()} == {c: CASES[c][2] for c in some}


def test_actual_patches_lead_from_one_table_to_the_other(spark):
    rng = random.Random(6)
    old = {f"f{k}": [rng.choice("abcde") for _ in range(rng.randint(0, 40))] for k in range(12)}
    new = {p: [x for x in ts if rng.random() > 0.2] + [rng.choice("xyz")] * rng.randint(0, 2) if p != "f3" else ts for p, ts in old.items()}
    rows = lifecycle.actual_patch(table(spark, old), table(spark, new)).orderBy("file", "idx").collect()
    assert "f3" not in {r.file for r in rows}
    for p in old:
        out, at = [], 0
        for r in (r for r in rows if r.file == p):
            first = r.old_start - 1 if r.old_lines else r.old_start
            out += old[p][at:first]
            assert [x.text for x in r.lines if x.tag == "-"] == old[p][first : first + r.old_lines]
            out += [x.text for x in r.lines if x.tag == "+"]
            at = first + r.old_lines
        assert out + old[p][at:] == new[p]
        assert sum(r.old_lines for r in rows if r.file == p) <= len(old[p]) - sum(b.size for b in difflib.SequenceMatcher(None, old[p], new[p], autojunk=False).get_matching_blocks()) + 40


def test_insertions_beyond_the_end_are_conflicts(spark):
    lines = table(spark, {"a": ["1", "2"], "b": ["1"], "c": ["1"]})
    hunks = [("s", "a", 0, 2, 0, 3, 1, [("+", "3")]), ("s", "b", 0, 2, 0, 3, 1, [("+", "3")]), ("s", "c", 0, 0, 0, 1, 1, [("+", "0")])]
    after, status = lifecycle.apply_hunks(lines, spark.createDataFrame(hunks, HUNKS))
    assert {r.path: r.status for r in status.collect()} == {"a": "APPLIED_SANDBOX", "b": "CONFLICT", "c": "APPLIED_SANDBOX"}
    assert {(r.path, r.line_no): r.text for r in after.collect()} == {("a", 1): "1", ("a", 2): "2", ("a", 3): "3", ("b", 1): "1", ("c", 1): "0", ("c", 2): "1"}
