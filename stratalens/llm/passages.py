"""Repeated passages of words, by compaction of a De Bruijn graph.

A window of WINDOW consecutive words is an edge between two nodes, its first and its last WINDOW - 1 words. Where a
passage repeats, its edges occur together; paths of such edges that never branch are compacted, so a repeated passage is
a few rows whatever its length:

1. Each window is tied to an anchor, its least-hashed gram of GRAM words; equal windows have equal anchors. Neighbouring
   windows with one anchor are a run. Anchors are counted, and only runs whose anchor occurs twice can repeat.
2. Runs of equal text are a class, with its count, its first source coordinates (document, place) and a fingerprint of
   all its coordinates. Only a class's first run is cut into edges, so copies cost a row for each run, not each window.
3. Edges are counted by their two nodes over the classes that hold them, with first coordinates and fingerprint. Edges
   that occur once are left out.
4. Two edges that share a node are joined if the second occurs exactly where the first does, one place later: the
   fingerprints of all their coordinates agree, so no occurrence of either branches off at that node. Then their first
   occurrences are neighbours as well, and a whole path is a run of neighbouring places of one document: what isn't
   joined to a predecessor or to a successor starts or ends a path.
5. The classes that hold a path's first edge, and their runs, give the coordinates of all its occurrences. All but the
   first are removed.

The fingerprint of a set of coordinates is the sum of hash(document) * base^place modulo a prime, for two primes: moved
by a place, a set's fingerprint is multiplied by the base.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U, arrow_map, as_long, col, dropped, mix, slices, stored, word_hashes

#: Words of a window, and of the grams that anchor windows.
WINDOW, GRAM = 20, 8
#: Bytes of text split at a time, and windows hashed at a time.
PIECE, BLOCK = 1 << 20, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ODD = 0xD6E8FEB86659FD93
#: Primes under 2^31 of the coordinates' fingerprints, and their bases; any others do as well. Fixed, so they agree.
_PRIMES, _BASES = (2**31 - 1, 2**31 - 19), (1_103_515_245, 1_566_083_941)


def pieces(raw: bytes):
    """A text in parts of about PIECE bytes that cut no word."""
    lo = 0
    while lo < len(raw):
        hi = lo + PIECE
        if hi < len(raw):
            while hi < len(raw):
                space = np.flatnonzero(_SPACE[np.frombuffer(raw, np.uint8, min(PIECE, len(raw) - hi), hi)])
                if len(space):
                    hi += int(space[0])
                    break
                hi = min(hi + PIECE, len(raw))
        yield raw[lo:hi]
        lo = hi


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in order, and where each text's words start (one entry more than texts)."""
    out, count = [], np.zeros(len(texts) + 1, np.int64)
    some: list[tuple[int, bytes]] = []
    size = 0

    def hashed():
        data = np.frombuffer(b" ".join(x for _, x in some) + b" ", np.uint8)
        word = ~_SPACE[data]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if word[:1].any():
            edge = np.concatenate([[0], edge])
        begin, end = edge[::2], edge[1::2]
        first = np.cumsum([0] + [len(x) + 1 for _, x in some])
        np.add.at(count, np.array([k for k, _ in some]) + 1, np.diff(np.searchsorted(begin, first)))
        out.append(word_hashes(data, begin, end))

    for k, t in enumerate(texts):
        for part in pieces(t):
            some.append((k, part))
            size += len(part)
            if size >= PIECE:
                hashed()
                some.clear()
                size = 0
    if some:
        hashed()
    return np.concatenate(out) if out else np.zeros(0, U), np.cumsum(count)


def run_hashes(z: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive codes, put together from runs of powers of two."""
    power, width, done, out = z, 1, 0, None
    while True:
        if n & width:
            if out is None:
                out = power
            else:  # the runs so far come first
                rest = power[done : done + max(len(out) - width, 0)]
                out = out[: len(rest)] * U(pow(_ODD, width, 1 << 64)) + rest
            done += width
        if done == n:
            return mix(out)
        power = power[: max(len(power) - width, 0)] * U(pow(_ODD, width, 1 << 64)) + power[width:]
        width *= 2


def anchored(z: np.ndarray, off: np.ndarray):
    """For the texts z[off[k]:off[k+1]]: runs of windows with one anchor, as (text, from, to, anchor, class), places in the
    text. The class is a hash of all the run's words; its first and last window overlap and hold them all."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    low, span = U((1 << 24) - 1), WINDOW - GRAM + 1
    for base in range(0, max(len(z) - WINDOW + 1, 0), BLOCK):
        grams = run_hashes(z[base : base + BLOCK + WINDOW - 1], GRAM)
        best = (grams & ~low) | np.arange(len(grams), dtype=U)  # ties: the leftmost
        wide = 1
        while wide < span:
            step = min(wide, span - wide)
            best = np.minimum(best[: len(best) - step], best[step:])
            wide += step
        start = np.arange(base, base + len(best))
        k = text[start]
        fits = start + WINDOW <= off[1:][k]
        start, k, at = start[fits], k[fits], (best[fits] & low).astype(np.int64)
        if not len(start):
            continue
        new = np.ones(len(start), bool)
        new[1:] = (at[1:] != at[:-1]) | (k[1:] != k[:-1])
        a = np.flatnonzero(new)
        last = np.append(a[1:], len(start)) - 1
        whole = run_hashes(z[base : base + BLOCK + WINDOW - 1], WINDOW)
        one, two = start[a] - base, start[last] - base
        yield k[a], start[a] - off[k[a]], start[last] - off[k[a]], grams[at[a]], mix(whole[one] * U(3) ^ mix(whole[two] + (two - one).astype(U)))


def _raw(column: pa.Array) -> list[bytes]:
    return [x.encode() if x else b"" for x in column.to_pylist()]


def _runs(source: DataFrame) -> DataFrame:
    def find(batches):
        for batch in batches:
            for b in slices(batch, 2):
                for k, lo, hi, m, c in anchored(*word_codes(_raw(b.column(2)))):
                    rows = pa.array(k)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), as_long(m), as_long(c), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["d", "h", "m", "c", "lo", "hi"])

    return arrow_map(source, find, "d bigint, h bigint, m bigint, c bigint, lo int, hi int")


def _marked(runs: DataFrame) -> DataFrame:
    """runs with f0, f1: the fingerprints of their first places."""

    def mark(batches):
        for b in batches:
            d, h = (np.asarray(b.column(i), np.int64).view(U) for i in (0, 1))
            doc, lo = mix(mix(d + U(1)) ^ h), np.asarray(b.column(4), np.int64)
            marks = []
            for p, base, part in zip(_PRIMES, _BASES, (doc >> U(32), doc & U(0xFFFFFFFF)), strict=True):
                x, g, left = part % U(p - 1) + U(1), U(base), lo.copy()
                while left.any():
                    x = np.where(left & 1, x * g % U(p), x)
                    g = g * g % U(p)
                    left >>= 1
                marks.append(pa.array(x.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns, *marks], names=["d", "h", "m", "c", "lo", "hi", "f0", "f1"])

    return arrow_map(runs, mark, "d bigint, h bigint, m bigint, c bigint, lo int, hi int, f0 bigint, f1 bigint")


def _edges(texts: DataFrame) -> DataFrame:
    """u, v, class, i, d, pos, h, n, f0, f1: the edges of the first run of each class (struct class, lo, hi, n, f0, f1); the
    class's fingerprints are those of the run's first place, i edges before."""
    names = ("class", "lo", "hi", "n", "f0", "f1")

    def find(batches):
        for batch in batches:
            for b in slices(batch, 2):
                z, off = word_codes(_raw(b.column(2)))
                inner = b.column(3).flatten()
                cls, lo, hi, n, *f = (np.asarray(inner.field(c), np.int64) for c in names)
                of = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(b.column(3).offsets)))
                order = np.argsort(off[of] + lo, kind="stable")
                cls, lo, hi, n, of, f = cls[order], lo[order], hi[order], n[order], of[order], [x[order] for x in f]
                size = hi - lo + 1
                ends = np.cumsum(size)
                for a, stop in _parts(ends):
                    run = np.repeat(np.arange(a, stop), size[a:stop])
                    i = np.arange(len(run)) - np.repeat(ends[a:stop] - size[a:stop] - (ends[a - 1] if a else 0), size[a:stop])
                    at = off[of[run]] + lo[run] + i
                    base = int(at[0])
                    # nodes of the words that these runs span, a block at a time
                    u, v = np.empty(len(at), U), np.empty(len(at), U)
                    for first in range(base, int(at[-1]) + 1, BLOCK):
                        some = slice(*np.searchsorted(at, (first, first + BLOCK)))
                        if some.start < some.stop:
                            nodes = run_hashes(z[first : first + BLOCK + WINDOW - 1], WINDOW - 1)
                            u[some], v[some] = nodes[at[some] - first], nodes[at[some] - first + 1]
                    rows = pa.array(of[run])
                    yield pa.RecordBatch.from_arrays([as_long(u), as_long(v), pa.array(cls[run]), pa.array(i.astype(np.int32)), b.column(0).take(rows), pa.array((lo[run] + i).astype(np.int32)), b.column(1).take(rows), pa.array(n[run]), *(pa.array(x[run]) for x in f)], names=["u", "v", "class", "i", "d", "pos", "h", "n", "f0", "f1"])

    return arrow_map(texts, find, "u bigint, v bigint, class bigint, i int, d bigint, pos int, h bigint, n bigint, f0 bigint, f1 bigint")


def _parts(ends: np.ndarray):
    """Ranges of runs that hold about BLOCK windows together; ends: windows up to and with each run."""
    a = 0
    while a < len(ends):
        stop = max(int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK)), a + 1)
        yield a, stop
        a = stop


def _paths(edges: DataFrame) -> DataFrame:
    """u, v (of the first edge), d, pos (of its first occurrence), size (edges) of each path that never branches.

    edges: u, v, n, first (d, pos, h), f0, f1.
    """
    e = edges.select("u", "v", "n", "first.d", "first.pos", "first.h", "f0", "f1")
    moved = [(F.col(f"f{k}") * g % p).alias(f"g{k}") for k, (g, p) in enumerate(zip(_BASES, _PRIMES, strict=True))]
    left = e.select("d", "h", F.col("pos").alias("p"), F.col("v").alias("node"), "n", *moved, (F.col("pos") + 1).alias("next"))
    right = e.select("u", "v", F.col("d").alias("d2"), F.col("h").alias("h2"), "pos", F.col("u").alias("node2"), F.col("n").alias("n2"), "f0", "f1")
    same = [F.col(a) == F.col(b) for a, b in (("node", "node2"), ("d", "d2"), ("h", "h2"), ("next", "pos"), ("n", "n2"), ("g0", "f0"), ("g1", "f1"))]
    ends = left.join(right, same, "full").where("d IS NULL OR d2 IS NULL")
    # no predecessor: (0) a path starts with this edge; no successor: (1) it ends with it
    ends = ends.select(F.coalesce("d", "d2").alias("d"), F.coalesce("h", "h2").alias("h"), F.coalesce("pos", "p").alias("pos"), F.col("d").isNotNull().cast("int").alias("kind"), "u", "v")
    by_place = Window.partitionBy("d", "h").orderBy("pos", "kind")
    return ends.withColumn("last", F.lead("pos").over(by_place)).where("kind = 0").select("u", "v", "d", "pos", (F.col("last") - F.col("pos") + 1).alias("size"))


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """d (doc_id, the least bigint for null), h (hash of the text), lo, hi: words lo to hi - 1 repeat an earlier passage.

    A word of the result lies in a window whose words also start earlier: in a smaller doc_id, or earlier in the same one.
    """
    source = docs.select(F.coalesce(col(doc_id).cast("bigint"), F.lit(-(2**63))).alias("d"), F.xxhash64(col(text)).alias("h"), col(text).alias("text")).where("text IS NOT NULL")
    # texts are split twice, so that runs which don't repeat are never written
    twice = stored(_runs(source).groupBy("m").count().where("count > 1").select("m"), "anchors")
    runs = stored(_runs(source).join(twice, "m", "left_semi").select("d", "h", "m", "c", "lo", "hi"), "runs")
    dropped(twice)
    sums = [(F.sum(f"f{k}") % p).alias(f"f{k}") for k, p in enumerate(_PRIMES)]
    classes = _marked(runs).groupBy("m", "c").agg(F.count("*").alias("n"), F.min(F.struct("d", "lo", "h", "hi")).alias("first"), *sums)
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    ranges = classes.groupBy("first.d", "first.h").agg(F.collect_list(F.struct("class", "first.lo", "first.hi", "n", "f0", "f1")).alias("ranges"))
    one = source.groupBy("d", "h").agg(F.first("text").alias("text"))  # a repeated row is one text
    places = stored(_edges(one.join(ranges, ["d", "h"]).select("d", "h", "text", "ranges")), "places")
    powers = lambda k: F.array(*[F.lit(pow(_BASES[k], i, _PRIMES[k])) for i in range(WINDOW)])
    sums = [(F.sum(F.col(f"f{k}") * F.element_at(powers(k), F.col("i") + 1) % p) % p).alias(f"f{k}") for k, p in enumerate(_PRIMES)]
    edges = stored(places.groupBy("u", "v").agg(F.sum("n").alias("n"), F.min(F.struct("d", "pos", "h")).alias("first"), *sums).where("n > 1"), "edges")
    paths = stored(_paths(edges), "paths")
    dropped(edges)
    heads = paths.select("u", "v", F.col("d").alias("d0"), F.col("pos").alias("pos0"), "size")
    found = stored(places.select("u", "v", "class", "i").join(heads, ["u", "v"]).join(classes.select("class", "m", "c"), "class").select("m", "c", "i", "d0", "pos0", "size"), "found")
    dropped(places, paths, classes)
    at = runs.join(found, ["m", "c"]).withColumn("lo", F.col("lo") + F.col("i")).where("d > d0 OR (d = d0 AND lo > pos0)")
    spans = stored(at.select("d", "h", "lo", (F.col("lo") + F.col("size") + (WINDOW - 1)).alias("hi")), "spans")
    dropped(runs, found)
    return spans


def without_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with keep_text kept (the words that stay, joined by a space), a row
    for each row of docs.

    Words are runs of characters other than space and 09-0D. A word is removed if a window of 20 words over it also
    starts earlier: in a document of smaller doc_id, or earlier in the same one; windows are judged on the input. Null
    and empty texts have no words, texts under 20 words keep all. A null id comes before all others. A repeated row gets
    the result of one; rows with one id and different texts are parts of one document that start at the same place.
    doc_id must be an integer; other columns aren't read.
    """
    source = docs.select(col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(col(doc_id).cast("bigint"), F.lit(-(2**63))).alias("d"), F.xxhash64(col(text)).alias("h"), col(text).alias("text"))
    spans = repeated_passages(docs, doc_id, text).groupBy("d", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    both = source.join(spans, ["d", "h"], "left").select("doc_id", "text", "spans")

    def cut(batches):
        for batch in batches:
            for b in slices(batch, 1):
                rows = [_kept(t, s or (), keep_text) for t, s in zip(_raw(b.column(1)), b.column(2).to_pylist(), strict=True)]
                words, removed, sha, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.string())] if keep_text else [])], names=["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if keep_text else [])])

    return arrow_map(both, cut, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if keep_text else ""))


def _kept(raw: bytes, spans, keep_text: bool) -> tuple[int, int, str, str | None]:
    """Words, words removed, SHA-256 of the rest and the rest; the words of a piece are in memory at a time."""
    merged: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    sha, parts, base, at, stay = hashlib.sha256(), [], 0, 0, 0
    for part in pieces(raw):
        words = part.split()
        left, lo = [], 0
        while at < len(merged) and merged[at][0] < base + len(words):
            left += words[lo : max(merged[at][0] - base, lo)]
            lo = merged[at][1] - base
            if lo > len(words):
                break  # the run goes on in the next piece
            at += 1
        left += words[lo:] if lo <= len(words) else []
        base += len(words)
        if left:
            text = b" ".join(left)
            sha.update(b" " + text if stay else text)
            stay += len(left)
            if keep_text:
                parts.append(text)
    return base, base - stay, sha.hexdigest(), b" ".join(parts).decode() if keep_text else None
