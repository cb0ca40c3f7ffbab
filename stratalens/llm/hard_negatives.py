"""Hard-negative mining: blocks of anchors against blocks of candidates, as exact float64 matrix products.

Components are quantised to integers, so a product of two blocks holds integers. While the largest absolute value of
either block, squared in this sense and times the dimension, stays below 2^53, float64 adds and multiplies them without
rounding, in any order, and BLAS may be used; blocks beyond that are multiplied as Python integers.

Anchors are written in files of at most a block each. For one block after another, two passes go over all candidates:

1. every task keeps, for each anchor of the block, its best positives (rows of its label) so far: a state of fixed size
   that merges with those of other tasks in any order;
2. the merged positives give each (anchor, positive) its window of scores, and every task keeps the best negatives in it.

A pass broadcasts one block, at most BLOCK_BYTES of components, and what the first pass found for it. Nothing else
reaches the driver, and no row meets another outside a product of blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, col, dropped, stored

#: Bytes of quantised anchors (float64) in a block, and rows of it at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 8_192
#: Anchors and candidates of one matrix product; a product's columns also number its ties, so there are fewer than 2^10.
TILE_ROWS, TILE_COLUMNS = 256, 1_000
#: Candidates that a task reads at least; more rows are dealt to more tasks.
TASK_ROWS = 16_384
#: Above this no float64 sum of products is trusted.
EXACT = 2**53
#: Lower than any score.
_NONE = -(2**62)


def quantised(vectors: DataFrame, row_id: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256) -> DataFrame:
    """id, label, q (floor(scale * x) of each component, as doubles): one row for each id, those that take part.

    Rows with a null id, label or vector, or a null or non-finite component, are left out. Of several rows with one id the
    least (label, components) stays.
    """
    x = F.transform(col(vector), lambda v: v.cast("double") * F.lit(float(scale)))
    q = F.transform(x, lambda v: F.when(F.abs(v) < F.lit(float(2**52)), F.floor(v).cast("double")).otherwise(v))  # beyond, every double is an integer
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(col(row_id).cast("bigint").alias("id"), col(label).cast("bigint").alias("label"), q.alias("q"), finite.alias("ok"))
    rows = rows.where("id IS NOT NULL AND label IS NOT NULL AND q IS NOT NULL AND ok")
    return rows.groupBy("id").agg(F.min(F.struct("label", "q")).alias("r")).select("id", "r.label", "r.q")


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors end in zeros, and what is beyond ``width`` meets only zeros."""
    size = np.diff(np.asarray(column.offsets, np.int64))
    flat = np.asarray(column.flatten(), np.float64)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    start = np.cumsum(size) - size
    for k, (a, n) in enumerate(zip(start.tolist(), np.minimum(size, width).tolist(), strict=True)):
        out[k, :n] = flat[a : a + n]
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of a and b as exact integers: int64, or Python integers where they may not fit."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    one, two = (np.array([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape) for m in (a, b))
    return one @ two.T


class Best:
    """For each of n slots the best k (score, id), higher scores first, then smaller ids. States merge in any order."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = np.full((n, k), _NONE, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max)

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Offer row r of scores, whose columns are ids in ascending order, to slots[r]; _NONE scores are no offers."""
        if scores.dtype == object:
            return self._add_any(slots, scores, ids)
        last = self.score[slots, -1]
        use = np.flatnonzero((scores.max(1, initial=_NONE) >= last) & (scores.max(1, initial=_NONE) > _NONE))
        if not len(use):
            return None
        scores, slots = scores[use], slots[use]
        n = scores.shape[1]
        if n > self.k and np.abs(np.where(scores == _NONE, 0, scores)).max(initial=0) < EXACT // 2:
            # a column's number makes scores differ, so ties go to smaller ids before the best k are cut out
            keyed = np.where(scores == _NONE, _NONE, scores * 1024 + (1023 - np.arange(n)))
            at = np.argpartition(-keyed, self.k - 1, axis=1)[:, : self.k]
            scores, ids = np.take_along_axis(scores, at, 1), ids[at]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        both, who = np.concatenate([self.score[slots], scores], 1), np.concatenate([self.id[slots], np.where(scores == _NONE, np.iinfo(np.int64).max, ids)], 1)
        order = np.lexsort((who, -both), axis=1)[:, : self.k]
        self.score[slots], self.id[slots] = np.take_along_axis(both, order, 1), np.take_along_axis(who, order, 1)
        return None

    def _add_any(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """The same for Python integers of any size."""
        self.score = self.score.astype(object)
        for r, s in enumerate(slots.tolist()):
            have = [x for x in zip(self.score[s].tolist(), self.id[s].tolist(), strict=True) if x[0] != _NONE]
            have += [x for x in zip(scores[r].tolist(), ids.tolist(), strict=True) if x[0] != _NONE]
            have = sorted(have, key=lambda x: (-x[0], x[1]))[: self.k]
            have += [(_NONE, np.iinfo(np.int64).max)] * (self.k - len(have))
            self.score[s], self.id[s] = [x[0] for x in have], [x[1] for x in have]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """slot, score, id of what was kept."""
        slot, place = np.nonzero(self.score != _NONE)
        return slot, self.score[slot, place], self.id[slot, place]


def _tiles(batches, anchor_ids: np.ndarray, a: np.ndarray):
    """(rows of a, products with a tile of candidates, their ids, their labels), candidates of a tile by ascending id."""
    for b in batches:
        ids, labels = np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)
        order = np.argsort(ids, kind="stable")
        for lo in range(0, len(ids), TILE_COLUMNS):
            part = order[lo : lo + TILE_COLUMNS]
            c = _matrix(b.column(2).take(pa.array(part)), a.shape[1])
            for top in range(0, len(a), TILE_ROWS):
                rows = np.arange(top, min(top + TILE_ROWS, len(a)))
                yield rows, products(a[rows], c), ids[part], labels[part]


def _long(x: np.ndarray) -> pa.Array:
    return pa.array([min(max(int(v), -(2**63)), 2**63 - 1) for v in x.tolist()] if x.dtype == object else x, pa.int64())


def _emit(best: Best, keys: list[np.ndarray], names: list[str]):
    slot, score, who = best.rows()
    text = [str(min(max(int(s), 1 - 10**38), 10**38 - 1)) for s in score.tolist()]
    yield pa.RecordBatch.from_arrays([*(pa.array(k[slot]) for k in keys), pa.array(text, pa.string()), pa.array(who)], names=[*names, "score", "id"])


def _merged(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The best k of what all tasks kept; ``score`` travels as text of at most 38 digits."""
    order = Window.partitionBy(*by).orderBy(F.col("score").cast("decimal(38,0)").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame,
    every: int = 100,
    row_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows whose id is divisible by ``every``. A score is the integer inner product of floor(scale * x). An anchor's positives are its best ``positives`` rows of the same label and another id; for each,
    the best ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive are returned.
    Higher scores come first, ties go to smaller ids.

    See ``quantised`` for nulls, non-finite components and repeated ids. Vectors of different lengths are compared over
    the components that both have. Scores are exact up to 38 digits; those beyond a bigint are returned as the nearest
    bigint. No anchor, no positive or no negative gives no row. Other columns of
    vectors are not read.
    """
    spark = vectors.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-vectors.count() // TASK_ROWS))
    ready = stored(quantised(vectors.repartition(tasks, col(row_id)), row_id, vector, label, scale), "vectors")
    chosen = ready.where(F.col("id") % every == 0)
    sizes = chosen.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("d")).first()
    width = max(sizes.d or 0, 1)
    rows = max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * width)))
    blocks = stored(chosen.repartition(max(1, -(-sizes.n // rows))), "anchors", max_records=rows)
    out = None
    for path in blocks.inputFiles():
        block = spark.read.schema(blocks.schema).parquet(path).toArrow()
        if block.num_rows:
            found = stored(_block(spark, ready, block, width, positives, negatives, low, high), "negatives")
            out = found if out is None else out.unionByName(found)
    dropped(blocks)
    if out is None:
        out = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return out


def _block(spark, ready: DataFrame, block: pa.Table, width: int, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """What hard_negatives returns, for one block of anchors."""
    whose = np.asarray(block.column("id"), np.int64)
    kind = np.asarray(block.column("label"), np.int64)
    shared = spark.sparkContext.broadcast((whose, kind, _matrix(block.column("q").combine_chunks(), width)))

    def same_label(batches):
        ids, labels, a = shared.value
        best = Best(len(ids), positives)
        for rows, s, who, what in _tiles(batches, ids, a):
            other = (labels[rows][:, None] != what[None, :]) | (ids[rows][:, None] == who[None, :])
            best.add(rows, np.where(other, _NONE, s), who)
        yield from _emit(best, [ids], ["anchor"])

    near = _merged(arrow_map(ready, same_label, "anchor bigint, score string, id bigint"), ["anchor"], positives).select("anchor", "score", "id").toArrow()  # a block's anchors times `positives`
    at = {int(x): k for k, x in enumerate(whose.tolist())}
    pairs = [(at[a], int(s), p) for a, s, p in zip(*(near.column(c).to_pylist() for c in ("anchor", "score", "id")), strict=True)]
    windows = sorted({(k, s) for k, s, _ in pairs})  # positives of one score share their window
    slot_of = {x: n for n, x in enumerate(windows)}
    firsts = np.array([slot_of[k, s] for k, s, _ in pairs], np.int64)
    # each slot's anchor, and the least and greatest score that its window holds
    bounds = spark.sparkContext.broadcast((np.array([k for k, _ in windows], np.int64), [-(-low * s // 100) for _, s in windows], [high * s // 100 for _, s in windows]))

    def other_label(batches):
        ids, labels, a = shared.value
        anchor, least, most = bounds.value
        big = max(map(abs, [*least, *most, 0])) >= 2**62
        least, most = (np.array(x, object if big else np.int64) for x in (least, most))
        best = Best(len(anchor), negatives)
        first = np.searchsorted(anchor, np.arange(len(ids) + 1))
        for rows, s, who, what in _tiles(batches, ids, a):
            slots = np.arange(first[rows[0]], first[rows[-1] + 1])
            if not len(slots):
                continue
            s = np.where(labels[rows][:, None] == what[None, :], _NONE, s)[anchor[slots] - rows[0]]
            best.add(slots, np.where((s >= least[slots][:, None]) & (s <= most[slots][:, None]), s, _NONE), who)
        yield from _emit(best, [np.arange(len(anchor))], ["slot"])

    got = _merged(arrow_map(ready, other_label, "slot bigint, score string, id bigint"), ["slot"], negatives)
    names = spark.createDataFrame(pa.table({"slot": pa.array(firsts, pa.int64()), "anchor_id": pa.array([int(whose[k]) for k, _, _ in pairs], pa.int64()), "positive_id": pa.array([p for _, _, p in pairs], pa.int64()), "positive_score": _long(np.array([s for _, s, _ in pairs], object))}))
    wide = F.greatest(F.least(F.col("score").cast("decimal(38,0)"), F.lit(2**63 - 1)), F.lit(-(2**63))).cast("bigint")
    return names.join(got, "slot").select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", wide.alias("negative_score"))
