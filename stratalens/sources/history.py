"""Version history as rows: a data source over a repository's log, diffs and blame."""

from __future__ import annotations

import re
import subprocess
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LOG_SCHEMA = "sha string, author string, email string, date_raw string, subject string, body string, files array<string>, ord bigint"
DIFF_SCHEMA = "sha string, diff string, ord bigint"
STATE_SCHEMA = "name string, value string"
_FORMAT = "%x1e%H%x1f%an%x1f%ae%x1f%ad%x1f%s%x1f%b%x1f"
#: Lines of a working tree's state at most.
STATUS_LINES = 200


class _Commits(InputPartition):
    """Commits of one partition, by id, and the place of the first in the whole order."""

    def __init__(self, shas: list[str], first: int):
        self.shas, self.first = shas, first


class HistorySource(DataSource):
    """``spark.read.format("history")`` with options path, mode (log, diff or state), max_count, grep, file, batch, ref, pushdown.

    log and diff: the ids of the commits are listed once, and each partition gets ``batch`` of them, which one process reads
    whatever their number. grep and file are pushed into the listing. With pushdown=true, where the session has
    ``spark.sql.python.filterPushdown.enabled``, so are a query's filters on sha (equal to, or in) and on subject
    (contains); Spark checks the rows again.
    A diff is that against the first parent; a first commit's is all it added. state: head (its commit), ref (what the
    option ``ref`` names), and a row for each of the first STATUS_LINES lines of the working tree's state.
    """

    @classmethod
    def name(cls) -> str:
        return "history"

    def schema(self) -> str:
        return {"diff": DIFF_SCHEMA, "state": STATE_SCHEMA}.get(self.options.get("mode"), LOG_SCHEMA)

    def reader(self, schema):
        return (_PushedReader if self.options.get("pushdown") == "true" else _HistoryReader)(dict(self.options))


class _HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.o = options
        self.most, self.batch = int(options.get("max_count", 100)), int(options.get("batch", 50))
        self.only: set[str] | None = None
        self.words: list[str] = []

    def _git(self, *args: str, given: str | None = None) -> str:
        done = subprocess.run(["git", "-C", self.o["path"], *args], capture_output=True, check=True, input=None if given is None else given.encode())
        return done.stdout.decode("utf-8", "replace")

    def partitions(self) -> list[InputPartition]:
        if self.o.get("mode") == "state":
            return [_Commits([], 0)]
        words = [f"--grep={self.o['grep']}"] if "grep" in self.o else []
        if self.words and not words:  # a listing takes one kind of pattern
            words = ["--fixed-strings", "--all-match", *(f"--grep={w}" for w in self.words if "\n" not in w)]
        listed = self._git("log", f"--max-count={self.most}", *words, "--format=%H", *(["--", self.o["file"]] if "file" in self.o else [])).split()
        found: list[InputPartition] = []
        for k in range(0, len(listed), self.batch):
            shas = listed[k : k + self.batch]
            if self.only is None or self.only & set(shas):
                found.append(_Commits(shas, k))
        return found

    def read(self, partition: _Commits) -> Iterator[tuple]:
        if self.o.get("mode") == "state":
            yield from self._state()
            return
        keep = [(k, sha) for k, sha in enumerate(partition.shas, partition.first) if self.only is None or sha in self.only]
        if not keep:
            return
        mark = uuid.uuid4().hex
        ids, place = "\n".join(sha for _, sha in keep), {sha: k for k, sha in keep}
        if self.o.get("mode") == "diff":
            out = self._git("log", "--no-walk=unsorted", "--stdin", "--root", "--patch", "--find-renames", "--first-parent", "-m", f"--format={mark}%H", given=ids)
            for part in out.split(mark)[1:]:
                sha, _, diff = part.partition("\n")
                yield sha, diff.lstrip("\n"), place[sha]
            return
        for part in self._git("log", "--no-walk=unsorted", "--stdin", f"--format={mark}{_FORMAT}", "--name-only", given=ids).split(mark)[1:]:
            fields = part.removeprefix("\x1e").split("\x1f")
            yield *(x.strip() for x in fields[:6]), [f for f in fields[6].split("\n") if f.strip()], place[fields[0].strip()]

    def _state(self) -> Iterator[tuple]:
        if subprocess.run(["git", "-C", self.o["path"], "rev-parse", "--git-dir"], capture_output=True).returncode:
            yield "is_repo", "false"
            return
        yield "is_repo", "true"
        for name, ref in (("head", "HEAD"), ("ref", self.o.get("ref"))):
            found = ref and subprocess.run(["git", "-C", self.o["path"], "rev-parse", "--verify", "--quiet", "--end-of-options", f"{ref}^{{commit}}"], capture_output=True, text=True)
            if found and found.returncode == 0:
                yield name, found.stdout.strip()
        for line in self._git("status", "--porcelain").split("\n")[:STATUS_LINES]:
            if line.strip():
                yield "status", line


class _PushedReader(_HistoryReader):
    def pushFilters(self, filters):
        """Take what narrows the listing; every filter is left for Spark as well, which judges the rows."""
        for f in filters:
            kind, column = type(f).__name__, getattr(f, "attribute", ())
            if column == ("sha",) and kind in ("EqualTo", "In"):
                named = {f.value} if kind == "EqualTo" else set(f.value)
                self.only = named if self.only is None else self.only & named
            elif column == ("subject",) and kind == "StringContains":
                self.words.append(f.value)
            yield f


def parse_log(raw: DataFrame, column: str = "value") -> DataFrame:
    """Commits from log text in rows: records end at 0x1e, fields at 0x1f, files follow a blank line."""
    rec = raw.select(F.posexplode(F.filter(F.split(column, "\x1e"), lambda x: F.trim(x) != "")).alias("ord", "r"))
    f = F.split("r", "\x1f")
    names = ["sha", "author", "email", "date_raw", "subject", "body"]
    return rec.select(*[F.trim(F.regexp_replace(F.get(f, k), r"^\s+|\s+$", "")).alias(n) for k, n in enumerate(names)], F.filter(F.split(F.get(f, 6), "\n"), lambda x: F.trim(x) != "").alias("files"), F.col("ord").cast("bigint").alias("ord"))


def commit_time(date_raw: Column | str) -> Column:
    """The default date text as a timestamp, so commits sort by time rather than by weekday."""
    return F.to_timestamp(F.regexp_replace(date_raw, r"^\w{3} ", ""), "MMM d HH:mm:ss yyyy Z")


HUNK_SCHEMA = "sha string, file string, idx int, old_start int, old_lines int, new_start int, new_lines int, header string, lines array<struct<tag:string,text:string>>, status string, old_path string"
_HEAD = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)")


def hunks_of(diff: str) -> Iterator[tuple]:
    """(file, idx, old_start, old_lines, new_start, new_lines, header, lines, status, old_path) of a unified diff.

    While a hunk's declared counts are open, a line belongs to it whatever it looks like; headers are looked for only
    in between. A file without hunks (a rename, a mode change) gives one row with a null idx.
    """
    file = old = None
    status, idx, hunk, left, seen = "modified", 0, None, [0, 0], False

    def bare():
        return [(file, None, None, None, None, None, None, None, status, old)] if file and not seen else []

    for line in (diff or "").split("\n"):
        if hunk is not None:
            tag = line[:1] or " "
            if left[0] > 0 or left[1] > 0:
                if tag in " +-\\":
                    hunk[7].append((tag, line[1:]))
                    left[0] -= tag in " -"
                    left[1] -= tag in " +"
                    continue
            elif tag == "\\":
                hunk[7].append((tag, line[1:]))
                continue
            yield tuple(hunk)
            hunk = None
        if line.startswith("diff --git "):
            yield from bare()
            m = re.match(r"diff --git a/(.*) b/(.*)$", line)
            file, old, status, idx, seen = (m[2] if m else None), None, "modified", 0, False
        elif line.startswith("new file"):
            status = "added"
        elif line.startswith("deleted file"):
            status = "deleted"
        elif line.startswith("rename from "):
            status, old = "renamed", line[12:]
        elif line.startswith("rename to "):
            file = line[10:]
        elif line.startswith("+++ ") and line[4:] != "/dev/null":
            file = re.sub(r"^b/", "", line[4:])
        elif line.startswith("--- ") and line[4:] != "/dev/null" and file is None:
            file = re.sub(r"^a/", "", line[4:])
        elif m := _HEAD.match(line):
            a, b, c, d = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            hunk, left, seen = [file, idx, a, b, c, d, m[5].strip(), [], status, old], [b, d], True
            idx += 1
    if hunk is not None:
        yield tuple(hunk)
    yield from bare()


def parse_diffs(diffs: DataFrame) -> DataFrame:
    """Hunks of diffs (sha, diff); each diff is read in order, commits in parallel."""

    def parse(batches):
        import pandas as pd

        names = [c.split()[0] for c in HUNK_SCHEMA.replace("struct<tag:string,text:string>", "x").split(", ")]
        for pdf in batches:
            rows = [(sha, *h) for sha, diff in zip(pdf["sha"], pdf["diff"], strict=True) for h in hunks_of(diff)]
            out = pd.DataFrame(rows, columns=names)
            out["lines"] = [None if x is None else [{"tag": t, "text": s} for t, s in x] for x in out["lines"]]
            for c in ("idx", "old_start", "old_lines", "new_start", "new_lines"):
                out[c] = out[c].astype("Int32")
            yield out

    return diffs.select("sha", "diff").mapInPandas(parse, HUNK_SCHEMA)


def parse_blame(raw: DataFrame, column: str = "value", first: int | None = None, last: int | None = None) -> DataFrame:
    """line_no, sha from the headers of porcelain blame, one text line in each row."""
    head = r"^([0-9a-f]{40}) \d+ (\d+)(?: \d+)?$"
    out = raw.where(F.col(column).rlike(head)).select(F.regexp_extract(column, head, 2).cast("int").alias("line_no"), F.regexp_extract(column, head, 1).alias("sha"))
    return out if first is None else out.where(F.col("line_no").between(first, last if last is not None else first))
