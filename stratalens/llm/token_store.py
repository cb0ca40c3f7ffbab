"""Token ids on disk as a content-addressed store: unique chunks, document recipes and Merkle manifests."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, col, delete, free_name, mix, new_path, slices, stored
from .mixing import order_key, range_of
from .pieces import pieces

#: Chunk sizes in ids: least, most, and the mean distance between content-defined cuts.
LEAST, MOST, MEAN = 64, 4096, 512
#: Ids in the rolling window that decides a cut.
WINDOW = 16
#: Generator of CRC-32, bits reversed (fixed value of the format).
CRC_POLY = 0xEDB88320
_MULT = np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ends of the content-defined chunks of several id streams that lie in one array, ids[off[k]:off[k+1]] each.

    A rolling hash over the last ``WINDOW`` ids allows a cut where it falls under 1/MEAN of its range; cuts nearer than
    LEAST to the last are passed over and a chunk of MOST ids is cut anyway. Equal streams get equal cuts.
    """
    h = mix(ids.astype(np.uint64) * _MULT + np.uint64(1))
    with np.errstate(over="ignore"):
        c = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h), out=c[1:])
    roll = np.zeros(len(ids), np.uint64)
    roll[WINDOW - 1 :] = mix(c[WINDOW:] - c[:-WINDOW]) if len(ids) >= WINDOW else 0
    may = np.flatnonzero((roll >> np.uint64(32)) < (1 << 32) // MEAN) + 1
    ends = []
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        at = lo
        if hi - lo > LEAST:
            own = may[np.searchsorted(may, lo + WINDOW) : np.searchsorted(may, hi)].tolist()
            for x in own:
                while x - at > MOST:
                    at += MOST
                    ends.append(at)
                if x - at >= LEAST:
                    at = x
                    ends.append(at)
            while hi - at > MOST:
                at += MOST
                ends.append(at)
        if hi > at:
            ends.append(hi)
    return np.array(ends, np.int64)


def _digest(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root over digests: pairs are hashed until one is left, an odd last one moves up."""
    if not leaves:
        return _digest(b"")
    while len(leaves) > 1:
        leaves = [_digest(b"\1" + a + b) for a, b in zip(leaves[::2], leaves[1::2], strict=False)] + ([leaves[-1]] if len(leaves) % 2 else [])
    return leaves[0]


def _lists(a: pa.Array) -> list[list[bytes] | None]:
    """A list column in Python, its values converted all at once."""
    flat, off, known = a.flatten().to_pylist(), np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(a), 0)))]).tolist(), a.is_valid().to_pylist()
    return [flat[lo:hi] if ok else None for lo, hi, ok in zip(off, off[1:], known, strict=False)]


def _part_roots(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_ids, root of each part of the recipes, as a manifest states them."""

    def manifest(batches):
        part, roots, n_ids, some = None, [], 0, False

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(roots)], pa.int64()), pa.array([n_ids], pa.int64()), pa.array([merkle(roots)], pa.binary())], names=["part", "n_docs", "n_ids", "root"])

        for b in batches:
            for p, n, r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if some and p != part:
                    yield row()
                    roots, n_ids = [], 0
                part, n_ids, some = p, n_ids + (n or 0), True
                roots.append(r or b"")
        if some:
            yield row()

    return arrow_map(recipes.repartition("part").sortWithinPartitions("part", "row").select("part", "n_ids", "root"), manifest, "part int, n_docs bigint, n_ids bigint, root binary")


def write_store(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int | None = 1, seed: str | None = None) -> None:
    """Encode whole texts (null: empty) and write the store under ``path``.

    chunks/    digest, n, data (little-endian ids, 2 bytes each if the vocabulary fits, else 4): each content once
    recipes/   part, doc_id, row, n_ids, digests, root: one for each document, ascending row within and across parts;
               root is the Merkle root of its chunks
    manifest/  part, n_docs, n_ids, root: the Merkle root over the recipes' roots of a part

    Rows are numbered by ascending doc_id (nulls first, repeated ids in the order they were read). With a ``seed`` they
    are numbered in the order of the mixing's global shuffle instead: by the MD5 of seed, doc_id and copy, where the
    copies of a document are its rows with equal ids and are counted from 0.

    doc_id must be an integer. Rows with a repeated doc_id are documents of their own. Other columns of docs play no part,
    whatever their names. A very long text is one stream of many chunks. An empty table gives an empty store.
    """
    spark = docs.sparkSession
    row, = free_name(docs, "row")
    source = docs.select(col(doc_id).cast("bigint").alias("doc_id"), col(text).alias("text")).withColumn(row, F.monotonically_increasing_id())

    def encode(batches):
        enc, seen = pieces(tokenizer), set()
        width = enc.kind.itemsize
        for batch in batches:
            for b in slices(batch, 1):
                ids, off = enc.flat(b.column(1))
                if end_id is not None:
                    ids, off = np.insert(ids, off[1:], end_id), off + np.arange(len(off))
                ends = chunk_ends(ids, off)
                of = np.searchsorted(off, ends, "left") - 1
                starts = np.maximum(np.concatenate([ends[:0], [0], ends[:-1]]), off[of]) if len(ends) else ends
                data = ids.tobytes()
                parts = [data[a * width : z * width] for a, z in zip(starts.tolist(), ends.tolist(), strict=True)]
                digests = [_digest(x) for x in parts]
                fresh = []
                for d, x in zip(digests, parts, strict=True):  # a task writes a content once
                    fresh.append(None if d in seen else x)
                    seen.add(d)
                if len(seen) > 1_000_000:
                    seen.clear()
                # a document without ids (empty text, no end id) still has a recipe
                none = np.setdiff1d(np.arange(b.num_rows), of)
                at = pa.array(np.concatenate([of, none]).astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), pa.array(np.concatenate([starts, np.zeros(len(none), np.int64)])), pa.array([*digests, *[None] * len(none)], pa.binary()), pa.array(np.concatenate([ends - starts, np.zeros(len(none), np.int64)]).astype(np.int32)), pa.array([*fresh, *[None] * len(none)], pa.binary())],
                    names=["doc_id", "row", "place", "digest", "n", "data"],
                )

    raw = new_path(spark, "ids")
    arrow_map(source.select("doc_id", "text", col(row).alias("row")), encode, "doc_id bigint, row bigint, place bigint, digest binary, n int, data binary").write.option("compression", "zstd").parquet(raw)
    ids = spark.read.parquet(raw)
    ids.where("data IS NOT NULL").select("digest", "n", "data").dropDuplicates(["digest"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes = ids.groupBy("doc_id", "row").agg(F.sum("n").cast("bigint").alias("n_ids"), F.transform(F.sort_array(F.collect_list(F.when(F.col("digest").isNotNull(), F.struct("place", "digest")))), lambda x: x.digest).alias("digests"))

    def rooted(batches):
        for b in batches:
            roots = [merkle(d) for d in _lists(b.column(3))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(roots, pa.binary())], names=["doc_id", "row", "n_ids", "digests", "root"])

    # written before they are put in order, so that finding the ranges doesn't build them a second time
    unordered = new_path(spark, "recipes")
    arrow_map(recipes, rooted, "doc_id bigint, row bigint, n_ids bigint, digests array<binary>, root binary").write.option("compression", "zstd").parquet(unordered)
    flat = spark.read.parquet(unordered)
    order = ["doc_id", "row"]
    if seed is not None:
        copy = F.row_number().over(Window.partitionBy("doc_id", "root").orderBy("row")) - 1
        flat, order = flat.withColumn("key", order_key(F.col("doc_id"), copy, seed)), ["key", "doc_id", "row"]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        flat = flat.repartitionById(parts, range_of("key", parts))
    else:
        flat = flat.repartitionByRange(*order)
    flat = flat.sortWithinPartitions(*order)
    flat.select(F.spark_partition_id().alias("part"), "doc_id", F.monotonically_increasing_id().alias("row"), "n_ids", "digests", "root").write.option("compression", "zstd").parquet(f"{path}/recipes")

    _part_roots(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")
    delete(spark, raw)
    delete(spark, unordered)


def _crc_steps() -> np.ndarray:
    """Matrix k appends 2^k zero bytes to a message whose CRC-32 is the vector; a column for each bit."""
    one = np.array([CRC_POLY, *(1 << k for k in range(31))], np.uint32)  # one zero bit
    out = []
    for k in range(3 + 48):
        if k >= 3:
            out.append(one)
        one = _times(one, one)
    return np.array(out)


def _times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    out = np.zeros(len(v), np.uint32)
    for bit in range(32):
        out ^= np.where((v >> np.uint32(bit)) & np.uint32(1), m[bit], np.uint32(0))
    return out


def crc_shifted(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """CRC-32 parts whose exclusive or is the CRC-32 of the whole: each moved over the bytes that follow it."""
    crc, steps = crc.astype(np.uint32).copy(), _crc_steps()
    for k in range(int(zeros.max(initial=0)).bit_length()):
        at = np.flatnonzero((zeros >> k) & 1)
        crc[at] = _times(steps[k], crc[at])
    return crc


def read_store(spark: SparkSession, path: str, tokenizer: str = "word_bpe_49k.json", width: int = 4) -> DataFrame:
    """Read a store back and verify it: doc_id, start, n_tokens, ids_crc32, verified, one row for each document.

    Each chunk's data is hashed against its digest and its ids summed up as a CRC-32 over ``width``-byte little-endian
    ids, so no stream needs to be joined together in one place: the parts' sums combine by the ids that follow them.
    verified: all chunks are there and match their digests, the recipe's Merkle root is that of its digests and its n_ids
    is the number of ids in them, and the root, documents and ids of its part are those of the manifest. A part of which
    the manifest tells but that has no recipes makes every document unverified, since no row of its own can say so.
    n_tokens and start count the ids of the chunks that were read; start counts those of all documents before, in the
    order of the recipes.
    """

    def check(batches):
        import zlib

        kind = pieces(tokenizer).kind
        for b in batches:
            data = b.column(1).to_pylist()
            ids = [np.frombuffer(x, kind) for x in data]
            sums = [zlib.crc32(x.astype(f"<u{width}").tobytes()) for x in ids]
            good = [_digest(x) == d for x, d in zip(data, b.column(0).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sums, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(good)], names=["digest", "crc", "n", "good"])

    chunks = arrow_map(spark.read.parquet(f"{path}/chunks").select("digest", "data"), check, "digest binary, crc bigint, n bigint, good boolean")
    recipes = spark.read.parquet(f"{path}/recipes")

    def rooted(batches):
        for b in batches:
            whole = [d is not None and None not in d and merkle(d) == r for d, r in zip(_lists(b.column(5)), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(whole, pa.bool_()), b.column(5)], names=["part", "doc_id", "row", "n_ids", "whole", "digests"])

    held = arrow_map(recipes.select("part", "doc_id", "row", "n_ids", "root", "digests"), rooted, "part int, doc_id bigint, row bigint, n_ids bigint, whole boolean, digests array<binary>")
    found = held.select("part", "doc_id", "row", "n_ids", "whole", F.posexplode_outer("digests").alias("pos", "digest")).join(chunks, "digest", "left")
    after = Window.partitionBy("part", "doc_id", "row").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    moved = found.withColumn("zeros", F.coalesce(F.sum("n").over(after), F.lit(0)) * width)

    def shift(batches):
        for b in batches:
            crc = np.asarray(b.column(5).fill_null(0), np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), pa.array(crc_shifted(crc, np.asarray(b.column(6), np.int64)).astype(np.int64)), b.column(7), b.column(8)], names=["part", "doc_id", "row", "n_ids", "whole", "crc", "n", "good"])

    shifted = arrow_map(moved.select("part", "doc_id", "row", "n_ids", "whole", "crc", "zeros", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("good", F.col("pos").isNull()).alias("good")), shift, "part int, doc_id bigint, row bigint, n_ids bigint, whole boolean, crc bigint, n bigint, good boolean")
    # repeated recipe rows count their chunks together, so the number of ids gives them away
    docs = shifted.groupBy("part", "doc_id", "row").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), (F.every("good") & F.every("whole") & F.every(F.col("n_ids").isNotNull()) & (F.min("n_ids") == F.max("n_ids")) & (F.sum("n") == F.max("n_ids"))).alias("good"))
    docs = stored(docs, "read")
    # parts as they are against the manifest; running totals within a part by a window, before a part by its rows (one
    # row for each file's worth of recipes)
    told = spark.read.parquet(f"{path}/manifest").groupBy("part").agg(F.count("*").alias("times"), F.max(F.struct("n_docs", "n_ids", "root")).alias("told"))
    ids = docs.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = _part_roots(recipes).select("part", F.struct("n_docs", "n_ids", "root").alias("seen")).join(told, "part", "full").join(ids, "part", "left")
    parts = parts.select(
        "part", (F.coalesce(F.col("seen") == F.col("told"), F.lit(False)) & (F.coalesce("times", F.lit(0)) == 1) & (F.count_if(F.col("seen").isNull()).over(Window.partitionBy()) == 0)).alias("as_told"),
        F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        docs.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(F.broadcast(parts), "part", "left")
        .select("doc_id", (F.coalesce("before", F.lit(0)) + F.col("inside")).alias("start"), "n_tokens", "ids_crc32", F.coalesce(F.col("good") & F.col("as_told"), F.lit(False)).alias("verified"))
    )
