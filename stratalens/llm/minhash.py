"""Near-duplicate groups: one-permutation hashing with optimal densification, bands, star-shaped candidates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratalens.operators.components import connected_components

from .common import U, arrow_map, as_long, col, dropped, free_name, joined, mix, slices, stored, word_hashes

#: Words of a shingle.
SHINGLE = 5
#: Chance at most with which a pair at the threshold shares no band, and bands that a signature has where they suffice.
MISS, BANDS = 1e-6, 64
#: Centres that an open bucket takes in one round after the first, each from another component, small ones first. As
#: buckets close, those left take more: a round makes at most STARS pairs for each member that there was at first.
STARS = 8
#: Cells of the shingle counts by which pairs are ruled out before their sets are compared.
CELLS = 128
#: A-Z lower-cased; space and 09-0D separate words.
_NORM = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c == 0x20 or 0x09 <= c <= 0x0D else c for c in range(256))
_EMPTY = U(2**64 - 1)


def shingle_sets(texts: list[str | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, one text after another, and where each text's start.

    A text of fewer words than a shingle, but some, has one: all its words. A text without words has none.
    """
    raw = [t.encode().translate(_NORM) if t else b"" for t in texts]
    data, off = joined(raw, 1)
    n = len(texts)
    if not len(data):
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    word = data != 0x20
    word[off[1:] - 1] = False  # the byte between texts
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    w = word_hashes(data, begin, end)
    count = np.bincount(np.searchsorted(off, begin, "right") - 1, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    # shingles start at each word that has enough after it; short texts give one from their first word
    own = np.where(count >= shingle, count - shingle + 1, (count > 0).astype(np.int64))
    text = np.repeat(np.arange(n), own)
    start = at[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(own) - own, own)
    size = np.minimum(count[text], shingle)
    h = size.astype(U)
    for j in range(shingle):
        inside = j < size
        h[inside] = mix(h[inside] * U(0x100000001B3) + w[start[inside] + j])
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[keep], text[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n))]).astype(np.int64)


def set_keys(h: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """16 bytes that stand for each whole set; None for an empty one."""
    sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(h ^ U(x)))]) for x in (0, 0x5BF03635)]
    key = np.stack([x[off[1:]] - x[off[:-1]] for x in sums], 1)
    return [k.tobytes() if n else None for k, n in zip(key, np.diff(off), strict=True)]


def signatures(h: np.ndarray, off: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of each set: the least hash in each bin; an empty bin borrows from the first non-empty bin
    of a sequence drawn by hashing (bin, attempt), which makes all bins' collisions independent given the set."""
    n = len(off) - 1
    sig = np.full((n, bins), _EMPTY)
    text = np.repeat(np.arange(n), np.diff(off))
    np.minimum.at(sig, (text, ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64)), mix(h))
    full = sig != _EMPTY
    live = np.flatnonzero(np.diff(off) > 0)
    row, cell = np.nonzero(~full[live])
    row = live[row]
    attempt = 0
    while len(row):
        attempt += 1
        source = (mix(cell.astype(U) * U(0x9E3779B1) + U(attempt << 20)) % U(bins)).astype(np.int64)
        got = full[row, source]
        sig[row[got], cell[got]] = sig[row[got], source[got]]
        row, cell = row[~got], cell[~got]
    return sig


def banding(percent: int, miss: float = MISS, most: int = BANDS) -> tuple[int, int]:
    """Bands and rows for a threshold: as many rows as ``most`` bands allow with (1 - threshold^rows)^bands <= miss.

    Where even one row a band needs more, there are more bands.
    """
    share = min(percent, 100) / 100
    if share >= 1:
        return 1, 16
    need = lambda rows: math.ceil(math.log(miss) / math.log1p(-(share**rows)))
    rows = 1
    while need(rows + 1) <= most:
        rows += 1
    return need(rows), rows


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, bins = sig.shape
    key = np.tile(np.arange(bins // rows, dtype=U), (n, 1))
    for r in range(rows):
        key = mix(key * U(0x100000001B3) + sig[:, r::rows][:, : bins // rows])
    return key


def cell_counts(h: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each set by hash cell, and which sets have at most 127 in every cell."""
    n = len(off) - 1
    cells = np.bincount(np.repeat(np.arange(n), np.diff(off)) * CELLS + (mix(h ^ U(0xA24BAED4)) % U(CELLS)).astype(np.int64), minlength=n * CELLS).reshape(n, CELLS)
    return cells, (cells <= 127).all(1)


def _may_be_near(percent: int):
    """Whether two members can reach the threshold: by their sizes, and by their cells. Exact, since an intersection has
    no more shingles in a cell than either set; sets with an overfull cell have no cells and aren't ruled out by them."""
    a, b = F.col("n_shingles"), F.col("c_size")
    both = F.aggregate(F.zip_with("cells", "c_cells", lambda x, y: F.least(x, y)), F.lit(0), lambda n, x: n + x)
    known = (F.size("cells") > 0) & (F.size("c_cells") > 0)
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & (~known | (100 * both >= percent * (a + b - both)))


def sketches(docs: DataFrame, doc_id: str, text: str, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (16 bytes that stand for the whole set; null if it is empty), bands, cells."""

    def sketch(batches):
        for batch in batches:
            for b in slices(batch, 1):
                h, off = shingle_sets(b.column(1).to_pylist(), shingle)
                size = np.diff(off)
                keys = band_keys(signatures(h, off, bands * rows), rows)
                at = np.where(size > 0, bands, 0)
                cells, fits = cell_counts(h, off)
                yield pa.RecordBatch.from_arrays([
                    b.column(0), pa.array(size), pa.array(set_keys(h, off), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(at)]).astype(np.int32)), as_long(keys[size > 0].ravel())),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(fits, CELLS, 0))]).astype(np.int32)), pa.array(cells[fits].ravel().astype(np.int8))),
                ], names=["doc_id", "n_shingles", "set_key", "bands", "cells"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return arrow_map(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), sketch, f"doc_id {kind}, n_shingles bigint, set_key binary, bands array<bigint>, cells array<tinyint>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id, shingles of the rows whose text has the set that stands for their id."""

    def make(batches):
        for batch in batches:
            for b in slices(batch, 1):
                h, off = shingle_sets(b.column(1).to_pylist(), shingle)
                right = pa.array([a == z for a, z in zip(set_keys(h, off), b.column(2).to_pylist(), strict=True)], pa.bool_())
                sets = pa.array([h[a:z].tobytes() for a, z in zip(off[:-1], off[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).filter(right), sets.filter(right)], names=["id", "shingles"])

    kind = docs.schema["id"].dataType.simpleString()
    return arrow_map(docs.select("id", "text", "set_key"), make, f"id {kind}, shingles binary")


def _confirmed(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b and the components of both, ca and cb) whose full sets satisfy 100 * |intersection| >= percent * |union|."""
    pairs = edges.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")

    def compare(batches):
        for b in batches:
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                lo, hi = sorted((len(x), len(y)))
                if 100 * lo < percent * hi:  # even containment falls short
                    good.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= percent * (lo + hi - common))
            at = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(i).filter(at) for i in (0, 1, 4, 5)], names=["a", "b", "ca", "cb"])

    kind = edges.schema["a"].dataType.simpleString()
    return arrow_map(pairs.select("a", "b", "x", "y", "ca", "cb"), compare, f"a {kind}, b {kind}, ca {kind}, cb {kind}")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85, shingle: int = SHINGLE, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Texts with equal shingle sets are one class, linked without comparing. Class representatives meet in buckets of
    equal bands. A bucket of one isn't kept; in another, each member is compared with one centre: the member that
    shares most buckets, which among near copies is their common source. Links are confirmed on full sets and
    contracted to components; while a bucket still holds several components, further centres are taken from some of
    the smaller ones, compared with the members of other components, and leave the bucket. So pairs inside a component
    are never made, a round makes at most STARS pairs for each first member, and every pair of different components that
    shares a bucket is confirmed or refuted.

    Where K components of one bucket stay apart for good, all K * (K - 1) / 2 pairs of them are refuted one by one; rounds
    are that many pairs over STARS times the first members, so a round's size never follows the bucket. A pair is compared in
    one round only, however many buckets it shares.

    Bands and rows follow ``percent`` so that a pair at the threshold shares no bucket with probability ``miss`` at most
    (at 85: 64 bands of 10, 8e-7); such a pair is missed only if no chain of others links it. Pairs that their sizes or their
    shingle counts by hash cell rule out aren't made. Texts without words have no links: component_id is their own id. Repeated ids are
    one document; if their texts differ, the text of the least set key is compared for it. Null ids stay rows of their own: they join groups by their sets, but never name one unless all its
    ids are null.
    """
    bands, rows = banding(percent, miss)
    all_docs = stored(sketches(docs, doc_id, text, shingle, bands, rows), "sketch")
    classes = all_docs.where("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("id"))
    # tables here grow with the corpus, so joins are merge joins at every size: skew is split, nothing is broadcast
    standing = classes.where("id IS NOT NULL").groupBy("id").agg(F.min("set_key").alias("set_key"))
    reps = all_docs.where("set_key IS NOT NULL AND doc_id IS NOT NULL").join(standing.select("set_key", F.col("id").alias("doc_id")).hint("merge"), ["set_key", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "n_shingles", F.explode("bands").alias("bucket"))
    full = reps.groupBy("bucket").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    first = stored(reps.join(full.select("bucket", "n").hint("merge"), "bucket").distinct(), "buckets")
    named = standing.join(first.select("id").distinct().hint("merge"), "id", "left_semi")
    cells = all_docs.select(F.col("doc_id").alias("id"), "set_key", "cells").join(named.hint("merge"), ["id", "set_key"], "left_semi").select("id", "cells").dropDuplicates(["id"])
    fame = first.groupBy("id").agg(F.sum("n").alias("fame"))
    members = stored(first.select("bucket", "id", "n_shingles", F.col("id").alias("comp")).join(fame.hint("merge"), "id").join(cells.hint("merge"), "id"), "members")
    dropped(first)
    wanted = stored(members.select("id").distinct(), "wanted")
    texts = docs.where(col(doc_id).isNotNull()).select(col(doc_id).alias("id"), col(text).alias("text"))
    named = standing.join(wanted.hint("merge"), "id", "left_semi")
    sets = stored(_sets(texts.join(named.hint("merge"), "id"), shingle).dropDuplicates(["id"]), "sets")
    comp = wanted.select("id", F.col("id").alias("comp"))
    at_first = rows = members.count()
    tried, first_round = None, True
    compared: list[DataFrame] = []
    while True:
        if first_round:
            centre = members.groupBy("bucket").agg(F.max_by(F.struct("id", "comp", "n_shingles", "cells"), F.struct("fame", "id")).alias("x")).select("bucket", F.col("x.id").alias("c"), F.col("x.comp").alias("c_comp"), F.col("x.n_shingles").alias("c_size"), F.col("x.cells").alias("c_cells"))
        else:
            sizes = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"), F.max_by(F.struct("id", "n_shingles", "cells"), F.struct("fame", "id")).alias("x"))
            by_size = Window.partitionBy("bucket").orderBy("n", "comp")
            ranked = sizes.withColumn("rank", F.row_number().over(by_size)).withColumn("more", F.lead("n").over(by_size))
            centre = ranked.where((F.col("rank") <= STARS * at_first // max(rows, 1)) & F.col("more").isNotNull()).select("bucket", F.col("x.id").alias("c"), F.col("comp").alias("c_comp"), F.col("x.n_shingles").alias("c_size"), F.col("x.cells").alias("c_cells"))
        centre = stored(centre, "centres")
        if centre.isEmpty():
            break
        met = members.join(centre.hint("merge"), "bucket").where((F.col("comp") != F.col("c_comp")) & _may_be_near(percent)).select("id", "c", "comp", "c_comp")
        up = F.col("id") < F.col("c")
        met = met.select(F.least("id", "c").alias("a"), F.greatest("id", "c").alias("b"), F.when(up, F.col("comp")).otherwise(F.col("c_comp")).alias("ca"), F.when(up, F.col("c_comp")).otherwise(F.col("comp")).alias("cb")).distinct()
        if tried is not None:  # a pair that shares several buckets is compared once
            met = met.join(tried.hint("merge"), ["a", "b"], "left_anti")
        met = stored(met, "pairs")
        tried = met.select("a", "b") if tried is None else tried.unionByName(met.select("a", "b"))
        compared.append(met)
        fresh = stored(_confirmed(met, sets, percent), "links")
        left = members.join(centre.select("bucket", F.col("c").alias("id")), ["bucket", "id"], "left_anti")
        if not fresh.isEmpty():  # components that a link joins become one; earlier links are in them already
            groups = connected_components(fresh, "ca", "cb")
            before = comp
            comp = stored(comp.join(groups.select(F.col("node").alias("comp"), "component").hint("merge"), "comp", "left").select("id", F.coalesce("component", "comp").alias("comp")), "comp")
            dropped(before)
            left = left.drop("comp").join(comp.hint("merge"), "id")
        dropped(fresh)
        first_round = False
        # only buckets with several components stay, without the centres that have met all others in them
        open_ = left.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        before = members
        members = stored(left.join(open_, "bucket", "left_semi"), "members")
        dropped(before, centre)
        rows = members.count()
        if not rows:
            break
    dropped(sets, members, *compared)
    of_class = classes.join(comp, "id", "left").select("set_key", F.coalesce("comp", "id").alias("comp"))
    out = all_docs.join(of_class, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest id. Columns stay those of docs.

    Rows with a repeated or a null id are judged by their own text: where there are any, all rows get a key of their id
    (nulls last) and their place, and the smallest key of a group stays.
    """
    if docs.groupBy(col(doc_id).alias("id")).agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL").isEmpty():
        own, = free_name(docs, "_kept_id")
        kept = near_duplicates(docs, doc_id, text, **more).where("kept").select(F.col("doc_id").alias(own))
        return docs.join(kept, col(doc_id) == F.col(own), "left_semi")
    row, key, own = free_name(docs, "_row", "_key", "_kept_row")
    placed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    keyed = placed.withColumn(key, F.struct(col(doc_id).isNull().alias("missing"), col(doc_id).alias("id"), F.col(row).alias("row")))
    kept = near_duplicates(keyed, key, text, **more).where("kept").select(F.col("doc_id.row").alias(own))
    return keyed.join(kept, F.col(row) == F.col(own), "left_semi").select(*[col(c) for c in docs.columns])
