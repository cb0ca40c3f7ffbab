"""Benchmark decontamination: stream training words through a generalised suffix automaton of the test items."""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, col, free_name, slices, stored

#: Consecutive words of an item that make a window; shorter items are one window each.
WINDOW = 10
#: Words of the items in one automaton; more items are dealt to several automata, one pass each.
BLOCK_WORDS = 200_000

#: A word is a run of bytes other than 00-2F, 3A-60 and 7B-7F, once A-Z are lower-cased.
_NORM = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_NORM).split(b" ") if text else []


class Automaton:
    """Generalised suffix automaton over the items' words, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        coded = [(name, [self.vocab.setdefault(w, len(self.vocab)) for w in words]) for name, words in items if words]
        for _, ids in coded:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: items of the windows: by state for windows of full length, by (state, length) for those of short items
        self.full: dict[int, set[str]] = {}
        self.short: dict[tuple[int, int], set[str]] = {}
        for name, ids in coded:
            state, size = 0, 0
            for c in ids:
                state, size = self.step(state, size, c)
                if size == window and len(ids) >= window:
                    self.full.setdefault(state, set()).add(name)
            if len(ids) < window:
                while self.len[self.link[state]] >= len(ids):
                    state = self.link[state]
                self.short.setdefault((state, len(ids)), set()).add(name)
        self.lengths = sorted({n for _, n in self.short}) + ([window] if self.full else [])
        self.least = min(self.lengths, default=0)

    def _copy(self, p: int, q: int, c: int) -> int:
        """A copy of state q for the strings that p reaches by c."""
        k = len(self.len)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = k
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = k
            p = self.link[p]
        return k

    def _extend(self, last: int, c: int) -> int:
        """Append a word after the string of state ``last``; states of earlier items are shared."""
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._copy(last, q, c)
        k = len(self.len)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = k
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[k] = q if self.len[q] == self.len[p] + 1 else self._copy(p, q, c)
        return k

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The longest suffix read that occurs in an item, up to a window's length: its state and length."""
        while state and c not in self.next[state]:
            state = self.link[state]
            size = self.len[state]
        nxt = self.next[state].get(c)
        if nxt is None:
            return 0, 0
        state, size = nxt, min(size + 1, self.window)
        while self.len[self.link[state]] >= size:
            state = self.link[state]
        return state, size

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str], int]:
        """Merged [start, end) runs of words inside windows that occur, their items, and the longest match seen."""
        n = len(words)
        if n < self.least or not self.lengths:
            return [], set(), 0
        ids = np.fromiter(map(self.vocab.get, words, itertools.repeat(-1)), np.int64, n)
        known = np.concatenate([[False], ids >= 0, [False]])
        edge = np.flatnonzero(known[1:] != known[:-1])
        spans, items, longest = [], set(), 0
        for lo, hi in edge.reshape(-1, 2).tolist():
            if hi - lo < self.least:
                continue
            state = size = 0
            for i, c in enumerate(ids[lo:hi].tolist(), lo + 1):
                state, size = self.step(state, size, c)
                longest = max(longest, size)
                best = 0
                if size == self.window and state in self.full:
                    best = size
                    items |= self.full[state]
                if self.short:
                    s = state
                    while s:
                        for m in self.lengths:
                            if self.len[self.link[s]] < m <= min(self.len[s], size) and (s, m) in self.short:
                                best = max(best, m)
                                items |= self.short[s, m]
                        s = self.link[s]
                if best:
                    a = i - best
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append((a, i))
        return spans, items, longest


def _blocks(bench: DataFrame, item_id: str, text: str, block_words: int) -> tuple[DataFrame, int]:
    """i, t, block of the items, dealt by hash to blocks of about ``block_words`` words, and how many blocks there are."""
    words = F.size(F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(col(text), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " "), lambda w: w != ""))
    total = bench.agg(F.sum(words).alias("n")).first().n or 0
    blocks = max(1, -(-int(total) // block_words))
    return bench.select(F.coalesce(col(item_id).cast("string"), F.lit("")).alias("i"), col(text).alias("t"), F.pmod(F.xxhash64(col(item_id), col(text)), F.lit(blocks)).alias("block")), blocks


def _automaton(items: DataFrame, block: int, window: int):
    """One block's automaton, broadcast: the driver and each worker hold that of the block which is being matched."""
    rows = items.where(F.col("block") == block).select("i", "t").collect()  # a block: its size is a parameter
    return items.sparkSession.sparkContext.broadcast(Automaton(sorted((r.i, [w for w in normal_words(r.t) if w]) for r in rows), window))


def _found_in_blocks(source: DataFrame, row: str, body: str, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """row, spans, items, longest of the rows that any block's items touch; block after block, each pass written."""
    at = [source.columns.index(c) for c in (row, body)]
    found = None
    for k in range(blocks):
        model = _automaton(items, k, window)

        def match(batches, model=model):
            for batch in batches:
                for b in slices(batch, at[1]):
                    out = [(r, s, sorted(i), n) for r, (s, i, n) in zip(b.column(at[0]).to_pylist(), (model.value.hits([w for w in normal_words(t) if w]) for t in b.column(at[1]).to_pylist()), strict=True) if n]
                    rows, spans, names, longest = zip(*out, strict=True) if out else ((), (), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([[list(x) for x in s] for s in spans], pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string())), pa.array(longest, pa.int64())], names=["row", "spans", "items", "longest"])

        part = stored(arrow_map(source, match, "row bigint, spans array<array<bigint>>, items array<string>, longest bigint"), "hits")
        model.destroy()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("found"), F.max("longest").alias("most"))  # a row for each block at most


def benchmark_hits(docs: DataFrame, bench: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, longest (bigint), items (sorted array<string>) and clean (text without the hit words).

    Words are runs of characters other than 00-2F, 3A-60 and 7B-7F after A-Z are lower-cased. A window is ``window``
    consecutive words of an item, or a whole shorter item that has words; a word is hit if it lies in an occurrence of
    one. longest is the longest match in words, up to a window. clean drops each hit run from its first word's first to
    its last word's last character. Null text has no words and stays null. Repeated rows get equal results, an empty
    benchmark hits nothing. Columns of docs named like a result are replaced; null item ids count as an empty name.

    One automaton holds about ``block_words`` item words, an item whole. A benchmark of one block is matched in the pass
    that returns the rows. A larger one is matched block by block over docs written with row numbers, one automaton in
    memory at a time, and what was found is joined to the rows: a scan for each block, memory of one.
    """
    new = ("n_words", "n_hit", "longest", "items", "clean")
    keep = [c for c in docs.columns if c.lower() not in new]
    row, body, spans, found, most = free_name(docs, "row", "body", "spans", "found", "most")
    source = docs.select(*[col(c) for c in keep], col(text).alias(body))
    at = len(keep)
    schema = ", ".join(f"`{c.replace('`', '``')}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", n_words bigint, n_hit bigint, longest bigint, items array<string>, clean string"
    items, blocks = _blocks(bench, item_id, item_text, block_words)
    if blocks == 1:
        model = _automaton(items, 0, window)
    else:
        source = stored(source.withColumn(row, F.monotonically_increasing_id()), "numbered")
        hits = _found_in_blocks(source, row, body, items, blocks, window)
        source = source.join(hits.select(F.col("row").alias(row), F.col("spans").alias(spans), F.col("found").alias(found), F.col("most").alias(most)), row, "left").select(*[col(c) for c in keep], body, spans, found, most)

    def match(batches):
        for batch in batches:
            for b in slices(batch, at):
                texts = b.column(at).to_pylist()
                split = [[w for w in normal_words(t) if w] for t in texts]
                if blocks == 1:
                    got = [model.value.hits(w) for w in split]
                else:
                    got = [(_merged(s or ()), i or (), n or 0) for s, i, n in zip(*(b.column(at + k).to_pylist() for k in (1, 2, 3)), strict=True)]
                hit = [sum(z - a for a, z in s) for s, _, _ in got]
                clean = [_without(t, s) if s else t for t, (s, _, _) in zip(texts, got, strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), pa.array([len(w) for w in split], pa.int64()), pa.array(hit, pa.int64()), pa.array([n for _, _, n in got], pa.int64()), pa.array([sorted(i) for _, i, _ in got], pa.list_(pa.string())), pa.array(clean, pa.string())], names=[*keep, *new])

    return arrow_map(source, match, schema)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.translate(_NORM))]
    keep, last = [], 0
    for a, z in spans:
        keep.append(raw[last : at[a][0]])
        last = at[z - 1][1]
    return b"".join([*keep, raw[last:]]).decode()


def decontaminated(docs: DataFrame, bench: DataFrame, text: str = "text", max_coverage: float = 0.5, **more) -> DataFrame:
    """docs without the benchmark's passages: hit runs are cut out of the text, and documents of which more than
    ``max_coverage`` of the words is hit are dropped. Clean documents stay as they are; columns stay those of docs."""
    found = benchmark_hits(docs, bench, text=text, **more)
    rest = found.where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    return rest.select(*[F.col("clean").alias(c) if c == text else col(c) for c in docs.columns])
