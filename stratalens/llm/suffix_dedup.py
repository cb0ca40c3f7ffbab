"""Exact removal of repeated substrings with difference-cover suffix sorting.

Every byte that lies in a 200-byte string which starts anywhere else is removed. Sorting the suffixes at every byte of
a corpus moves many times its size, so only suffixes that can repeat are sorted:

1. Each window (200 bytes from one start) is tied to an anchor: the start of the least-hashed 16-gram among its first
   128. Equal windows have equal anchors at equal distances. The windows tied to one anchor are a context; what all of
   them contain is its core. Contexts are collapsed to classes of equal text before anything is shuffled.
2. A core that occurs once settles its windows as unique. A class that occurs twice settles its windows as repeated.
   What stays open are the classes of cores with several classes: texts that agree for a while and then differ.
3. Open classes are dealt by core, one text for each class, and a suffix array over their windows is built by the
   difference cover {1, 2} modulo 3: triples at sampled positions are sorted and named, names of triples of names are
   named in turn until they span the window, remaining positions are merged through the names that follow them, and
   neighbours in sorted order are compared. A group that is too large for one task goes the same way with each sort spread
   over tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rolling, U, arrow_map, as_long, col, delete, gram_hashes, joined, mix, new_path, slices, stored

#: Bytes of a string whose repetition counts; grams that anchor windows and how many of them a window chooses from.
LENGTH, GRAM, SPAN = 200, 16, 128
#: Bytes of text hashed at a time, and window starts of a huge text handled at a time.
PIECE = 1 << 20
#: Bytes of class texts that one task's suffix array spans; that of a larger group is sorted across tasks.
GROUP_BYTES = 2 << 20
#: Least and most bits of the two filters that tell which anchors the second scan reports: 16 for each key, 64 MB at most.
#: Over more than some 30 million keys they let more rows through than they need, which costs traffic and changes no result.
FILTER_BITS = (1 << 23, 1 << 29)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """For texts data[off[k]:off[k+1]]: each run of window starts a..b with one anchor.

    Returns the text's number, a, b (places in data), the core's and the context's hash.
    """
    roll = Rolling(data)
    grams = gram_hashes(np.concatenate([data, np.zeros(8, np.uint8)]), max(len(data) - GRAM + 1, 0))
    low = U((1 << 24) - 1)
    best = (grams & ~low) | np.arange(len(grams), dtype=U)  # ties: the leftmost
    wide = 1
    while wide < SPAN:
        best = np.minimum(best[: len(best) - wide], best[wide:]) if len(best) > wide else best[:0]
        wide *= 2
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    start = np.arange(len(best))
    inside = start + LENGTH <= off[1:][text[: len(best)]] if len(best) else np.zeros(0, bool)
    start = start[inside]
    anchor = (best[inside] & low).astype(np.int64)
    first = np.ones(len(start), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(first)
    a = start[at]
    b = np.append(start[at[1:] - 1], start[-1:]) if len(at) else a
    p = anchor[at]
    core = roll.of(p, p + (LENGTH - SPAN + 1))
    return text[a] if len(a) else a, a, b, core, mix(roll.of(a, b + LENGTH) ^ mix((p - a).astype(U) + U(1)))


def _pieces(texts: list[bytes]):
    """Joined texts of about PIECE bytes, a huge text in overlapping parts: data, offsets, text numbers, bases."""
    some, whose, base, total = [], [], [], 0
    for k, t in enumerate(texts):
        for lo in range(0, max(len(t) - LENGTH + 1, 0), PIECE):
            part = t[lo : lo + PIECE + LENGTH - 1]
            some.append(part)
            whose.append(k)
            base.append(lo)
            total += len(part)
            if total >= PIECE:
                yield *joined(some), np.array(whose), np.array(base)
                some, whose, base, total = [], [], [], 0
    if some:
        yield *joined(some), np.array(whose), np.array(base)


def _words(data: np.ndarray, n: int) -> np.ndarray:
    """The big-endian number in the 8 bytes from each of the first n places."""
    w = np.zeros(n, U)
    for k in range(8):
        w = (w << U(8)) | data[k : k + n]
    return w


def _ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorting order (first key first) and each element's rank; equal keys share one."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


def repeated_windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the windows data[s:s+200] occur at two of the starts or more, by difference-cover suffix sorting.

    Sampled are the places i with i % 3 in (1, 2). Their triples of 8-byte characters are sorted and named, then the
    triples of names 24 apart, so names span 72 bytes; steps are multiples of 3 and stay in the sample. Any two places
    x, y have a d in 0..2 with x + d and y + d both sampled, so two windows compare by d characters and names: places
    1 and 2 by names alone, 0 and 1 one character on, 0 and 2 two characters on. In each of the three sorted lists
    neighbours with equal keys are equal windows.
    """
    n = len(data)
    data = np.concatenate([data, np.zeros(LENGTH + 64, np.uint8)])
    words = _words(data, n + 16)
    sample = np.flatnonzero(np.arange(n) % 3 != 0)
    names = np.zeros(n + LENGTH + 64, np.int64)
    names[sample] = _ranks([words[sample], words[sample + 8], words[sample + 16]])[1]
    spans = np.zeros_like(names)
    spans[sample] = _ranks([names[sample] << 32 | names[sample + 24], names[sample + 48]])[1]
    out = np.zeros(len(starts), bool)
    c = data.astype(np.int64)
    for d, classes in ((0, (1, 2)), (1, (0, 1)), (2, (0, 2))):
        at = np.flatnonzero(np.isin(starts % 3, classes))
        s = starts[at]
        i = s + d
        # d characters, 3 names that span 198 bytes (at d = 2 they end with the window), the characters left
        edge = c[s] << 8 if d == 1 else (c[s] << 8 | c[s + 1]) if d == 2 else c[s + 198] << 8 | c[s + 199]
        if d == 1:
            edge = edge | c[s + 199]
        keys = [spans[i] << 32 | spans[i + 72], spans[i + 126] << 16 | edge]
        order, rank = _ranks(keys)
        r = rank[order]
        same = r[1:] == r[:-1]
        hit = np.zeros(len(at), bool)
        hit[1:] |= same
        hit[:-1] |= same
        out[at[order[hit]]] = True
    return out


def _named(rows: DataFrame, name: str) -> DataFrame:
    """core, cls, at and the name of each row's key: its place among the distinct keys, which are sorted over ranges."""
    ordered = rows.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    names = stored(ordered.select("key", F.monotonically_increasing_id().alias("name")), name)
    return rows.join(names, "key").select("core", "cls", "at", "name")


def windows_sorted_across_tasks(texts: DataFrame) -> DataFrame:
    """core, cls, from, to: windows of some texts (core, cls, body) whose bytes occur at two starts or more.

    The difference cover of repeated_windows with every sort spread over tasks: triples at sampled places are sorted and
    named, triples of names are named again, each window gets keys of three such names and two bytes, one for each
    of the two ways in which a window of its residue meets others, and neighbours in each sorted list are compared. A text is
    a context (under 400 bytes), so what is brought together for one is bounded; keys of a hot passage are many rows, but
    distinct ones are found before they are named.
    """
    texts = stored(texts, "open")

    def triples(batches):
        for b in batches:
            core, cls, at, key = [], [], [], []
            for c, k, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                places = [i for i in range(len(t) - 23) if i % 3]
                core += [c] * len(places)
                cls += [k] * len(places)
                at += places
                key += [t[i : i + 24] for i in places]
            yield pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(cls, pa.int64()), pa.array(at, pa.int32()), pa.array(key, pa.binary())], names=["core", "cls", "at", "key"])

    def of_names(step):
        """Rows of keys made of a text's bytes and the names at its places."""

        def make(batches):
            for b in batches:
                core, cls, at, key = [], [], [], []
                for c, k, t, named in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                    for place, x in step(t, {r["at"]: r["name"].to_bytes(8, "big") for r in named}):
                        core.append(c)
                        cls.append(k)
                        at.append(place)
                        key.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(core, pa.int64()), pa.array(cls, pa.int64()), pa.array(at, pa.int32()), pa.array(key, pa.binary())], names=["core", "cls", "at", "key"])

        return make

    def spans(t, names):
        return ((i, names[i] + names[i + 24] + names[i + 48]) for i in range(len(t) - 71) if i % 3)

    def windows(t, names):
        for s in range(len(t) - LENGTH + 1):
            for d, residues in ((0, (1, 2)), (1, (0, 1)), (2, (0, 2))):
                if s % 3 in residues:
                    edge = t[s + 198 : s + 200] if d == 0 else t[s : s + 1] + t[s + 199 : s + 200] if d == 1 else t[s : s + 2]
                    yield s, bytes([d]) + names[s + d] + names[s + d + 72] + names[s + d + 126] + edge

    def per_text(named):
        return texts.join(named.groupBy("core", "cls").agg(F.collect_list(F.struct("at", "name")).alias("named")), ["core", "cls"]).select("core", "cls", "body", "named")

    rows = "core bigint, cls bigint, at int, key binary"
    keys = stored(arrow_map(texts.select("core", "cls", "body"), triples, rows), "triples")
    keys = stored(arrow_map(per_text(_named(keys, "names")), of_names(spans), rows), "spans")
    keys = arrow_map(per_text(_named(keys, "names")), of_names(windows), rows)

    def neighbours(batches):
        before = None  # the last row so far: key, core, cls, at, and whether it was told

        for b in batches:
            out = []
            for core, cls, at, key in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                same = before is not None and before[0] == key
                if same and not before[4]:
                    out.append(before[1:4])
                if same:
                    out.append((core, cls, at))
                before = (key, core, cls, at, same)
            c, k, s = zip(*out, strict=True) if out else ((), (), ())
            place = pa.array([int(x) for x in s], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(k, pa.int64()), place, place], names=["core", "cls", "from", "to"])

    # equal keys share a range, so no pair of equal neighbours is split between tasks
    return arrow_map(keys.repartitionByRange("key").sortWithinPartitions("key").select("core", "cls", "at", "key"), neighbours, "core bigint, cls bigint, from bigint, to bigint")


def _bits(key: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(key)
    return (h % U(size)).astype(np.int64), ((h >> U(32)) % U(size)).astype(np.int64)


def _filter(keys: DataFrame, size: int) -> np.ndarray:
    """Bloom filter of a table's keys as bytes of bits; at most size / 64 rows reach the driver."""

    def places(batches):
        for b in batches:
            one, two = _bits(np.asarray(b.column(0), np.int64).view(U), size)
            at = np.unique(np.concatenate([one, two]))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((U(1) << (at & 63).astype(U)).view(np.int64))], names=["word", "bit"])

    words = arrow_map(keys, places, "word bigint, bit bigint").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(size // 64, U)
    out[np.asarray(words.column("word"), np.int64)] = np.asarray(words.column("bits"), np.int64).view(U)
    return out


def _filter_size(n: int) -> int:
    """Bits for so many keys: 16 for each, a power of two within FILTER_BITS."""
    return min(max(1 << (16 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def _in(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    one, two = _bits(key, len(words) * 64)
    return ((words[one >> 6] >> (one & 63).astype(U)) & (words[two >> 6] >> (two & 63).astype(U)) & U(1)).astype(bool)


def _rep_key(core: np.ndarray, cls: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(core * U(3) + cls) ^ mix(doc + U(0x51ED27))


def _scan(batches, of):
    for batch in batches:
        for b in slices(batch, 2):
            raw = [x.encode() if x else b"" for x in b.column(2).to_pylist()]
            ids = np.asarray(b.column(0).fill_null(-1), np.int64)
            for data, off, whose, base in _pieces(raw):
                yield from of(b, ids, data, off, whose, base)


def repeated_ranges(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), lo, hi: ranges of window starts whose windows start anywhere else as well."""
    source = docs.select(col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(col(text)).alias("h"), col(text).alias("text"))

    def classes(batches):
        def of(b, ids, data, off, whose, base):
            k, _, _, core, cls = anchors(data, off)
            order = np.lexsort((ids[whose[k]], cls, core))
            core, cls, doc = core[order], cls[order], ids[whose[k]][order]
            new = np.ones(len(core), bool)
            new[1:] = (core[1:] != core[:-1]) | (cls[1:] != cls[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(core)))
            yield pa.RecordBatch.from_arrays([as_long(core[at]), as_long(cls[at]), pa.array(n), pa.array(doc[at])], names=["core", "cls", "n", "rep"])

        return _scan(batches, of)

    found = arrow_map(source, classes, "core bigint, cls bigint, n bigint, rep bigint")
    spark = docs.sparkSession
    # both sides of the join below need the counts: written once, or the texts would be hashed for each side
    path = new_path(spark, "counted")
    found.groupBy("core", "cls").agg(F.sum("n").alias("n"), F.min("rep").alias("rep")).write.option("compression", "zstd").parquet(path)
    counted = spark.read.parquet(path)
    kinds = counted.groupBy("core").agg(F.sum("n").alias("all_n"), F.count("*").alias("kinds")).where("all_n > 1")
    # a class: repeated (n > 1), or alone in a core with other classes; open: its core has several classes
    known = stored(counted.join(kinds, "core").select("core", "cls", "n", "rep", "kinds"), "classes")
    delete(spark, path)
    open_ = known.where("kinds > 1")

    def keyed(df, with_rep):
        def key(batches):
            for b in batches:
                core, cls, rep = (np.asarray(b.column(i), np.int64).view(U) for i in range(3))
                yield pa.RecordBatch.from_arrays([as_long(_rep_key(core, cls, rep) if with_rep else mix(core * U(3) + cls))], names=["key"])

        return arrow_map(df.select("core", "cls", "rep"), key, "key bigint")

    any_filter = spark.sparkContext.broadcast(_filter(keyed(known, False), _filter_size(known.count())))
    text_filter = spark.sparkContext.broadcast(_filter(keyed(open_, True), _filter_size(open_.count())))

    def report(batches):
        maybe, reps = any_filter.value, text_filter.value

        def of(b, ids, data, off, whose, base):
            k, a, z, core, cls = anchors(data, off)
            keep = _in(maybe, mix(core * U(3) + cls))
            k, a, z, core, cls = k[keep], a[keep], z[keep], core[keep], cls[keep]
            if not len(k):
                return
            # neighbouring runs of one class (periodic text) are one row
            new = np.ones(len(k), bool)
            new[1:] = (k[1:] != k[:-1]) | (cls[1:] != cls[:-1]) | (core[1:] != core[:-1]) | (a[1:] != z[:-1] + 1)
            at = np.flatnonzero(new)
            last = np.append(at[1:], len(k)) - 1
            row = whose[k[at]]
            shift = base[k[at]] - off[:-1][k[at]]
            told = _in(reps, _rep_key(core[at], cls[at], ids[row].view(U)))
            raw = data.tobytes()
            body = [raw[x : y + LENGTH] if t else None for x, y, t in zip(a[at].tolist(), z[at].tolist(), told.tolist(), strict=True)]
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), as_long(core[at]), as_long(cls[at]), pa.array(a[at] + shift), pa.array(z[last] + shift), pa.array(body, pa.binary())], names=["doc_id", "h", "core", "cls", "lo", "hi", "body"])

        return _scan(batches, of)

    runs = stored(arrow_map(source, report, "doc_id bigint, h bigint, core bigint, cls bigint, lo bigint, hi bigint, body binary"), "runs")
    again = runs.select("doc_id", "h", "core", "cls", "lo", "hi").join(known.select("core", "cls", "n"), ["core", "cls"])
    whole = again.where("n > 1").select("doc_id", "h", "lo", "hi")

    texts = runs.where("body IS NOT NULL").select("core", "cls", "body").join(open_.select("core", "cls", "n", "kinds"), ["core", "cls"]).dropDuplicates(["core", "cls"])
    most = GROUP_BYTES // (LENGTH + SPAN)
    small = texts.where(F.col("kinds") <= most).select("core", "cls", "n", "body").repartition("core").sortWithinPartitions("core")

    def sort_suffixes(batches):
        def settle(rows):
            bodies = [r[3] for r in rows]
            data, off = joined(bodies)
            count = np.diff(off) - (LENGTH - 1)
            k = np.repeat(np.arange(len(rows)), count)
            inner = np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
            hit = repeated_windows(data, off[:-1][k] + inner)
            yield from _told(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows]) == 1, k, inner, hit)

        rows, size = [], 0
        for b in batches:
            for r in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if size >= GROUP_BYTES and rows[-1][0] != r[0]:
                    yield from settle(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[3])
        if rows:
            yield from settle(rows)

    sorted_ = arrow_map(small, sort_suffixes, "core bigint, cls bigint, from bigint, to bigint")

    large = texts.where(F.col("kinds") > most).select("core", "cls", "body")
    hits = sorted_.unionByName(windows_sorted_across_tasks(large)) if not open_.where(F.col("kinds") > most).isEmpty() else sorted_
    part = again.where("n = 1").join(hits, ["core", "cls"]).select("doc_id", "h", (F.col("lo") + F.col("from")).alias("lo"), (F.col("lo") + F.col("to")).alias("hi"))
    return whole.unionByName(part)


def _told(core, cls, alone, k, inner, hit):
    """Runs of repeated windows within each class that occurs once (other classes are settled)."""
    hit = hit & alone[k]
    at = np.flatnonzero(hit)
    if not len(at):
        return
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (k[at[1:]] != k[at[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    yield pa.RecordBatch.from_arrays([pa.array(core[k[at[first]]]), pa.array(cls[k[at[first]]]), pa.array(inner[at[first]]), pa.array(inner[at[last]])], names=["core", "cls", "from", "to"])


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text kept (binary: what is left, which may cut a
    character in two) for each row of docs.

    A byte is removed if a 200-byte string over it starts anywhere else, in the same or another text; strings are judged
    on the input and never cross texts. Null text is empty; texts under 200 bytes keep all. Rows with one id and
    different texts are texts of their own; a repeated row is an exact copy, so both lose what 200 bytes cover.
    doc_id must be an integer; null ids are allowed.
    """
    ranges = repeated_ranges(docs, doc_id, text).groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("r"))
    source = docs.select(col(doc_id).cast("bigint").alias("doc_id"), F.xxhash64(col(text)).alias("h"), col(text).alias("text"))
    other = ranges.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "r")
    both = source.join(other, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left").select("doc_id", "text", "r")

    def cut(batches):
        for batch in batches:
            for b in slices(batch, 1):
                n_bytes, removed, n_spans, kept = [], [], [], []
                for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw = t.encode() if t else b""
                    spans: list[list[int]] = []
                    for lo, hi in sorted((x["lo"], x["hi"]) for x in r or ()):
                        if spans and lo <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], hi + LENGTH)
                        else:
                            spans.append([lo, hi + LENGTH])
                    left, last = [], 0
                    for lo, hi in spans:
                        left.append(raw[last:lo])
                        last = hi
                    kept.append(b"".join([*left, raw[last:]]))
                    n_bytes.append(len(raw))
                    removed.append(len(raw) - len(kept[-1]))
                    n_spans.append(len(spans))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), *([pa.array(kept, pa.binary())] if keep_text else [])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else [])])

    return arrow_map(both, cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if keep_text else ""))
