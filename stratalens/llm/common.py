"""What the operators of this subpackage share: scratch tables, Arrow helpers, vectorised hashing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_made: dict[str, SparkSession] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and Spark runs on this machine alone (tests, a laptop) a temporary folder is made and set as
    the checkpoint folder; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        where = sc.getCheckpointDir()
        if not where:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            where = tempfile.mkdtemp(prefix="stratalens-")
            sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/stratalens/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Spark removes the shuffle files of what runs in here when it has ended, instead of when the driver collects its
    garbage. For plans that run once."""
    had = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if had is None else spark.conf.set(_CLEANUP, had)


def stored(df: DataFrame, name: str, max_records: int = 0) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors. With
    max_records no file has more rows."""
    path = new_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").option("maxRecordsPerFile", max_records).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        if df is not None and (path := df.__dict__.pop("_scratch", None)):
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, so any store works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _made.pop(path, None)


@atexit.register
def _clean() -> None:
    for path, spark in list(_made.items()):
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def free_name(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that clash with no column of df."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


#: Bytes of an Arrow batch and rows of a Parquet batch: rows here are whole documents, and batches of Spark's own size (64
#: MB, 4,096 rows) are held several times over by each task, in large arrays, outside the heap and in its Python worker.
BATCH_BYTES, SCAN_ROWS = 2 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Settings of the session for tables of documents; smaller ones that are set already stay."""
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS)):
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, str(most))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow over small batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


#: Rows of a slice: what a row costs beside its text (signatures, say) is bounded as well.
SLICE_ROWS = 1_000


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of about ``most`` text bytes and at most SLICE_ROWS rows, so memory doesn't follow the batch."""
    a = batch.column(text)
    if batch.num_rows == 0:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(a.cast(pa.binary())), 0), dtype=np.int64)
    part = np.cumsum(sizes) // most + (np.arange(len(sizes)) // SLICE_ROWS << 32)
    cut = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cut], [*cut, batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def joined(texts: list[bytes], gap: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one uint8 array, ``gap`` zero bytes after each, and where each starts (one entry more than texts)."""
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + gap for t in texts], out=off[1:])
    return np.frombuffer((b"\0" * gap).join(texts) + b"\0" * gap if texts else b"", np.uint8), off


U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (a bijection)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def eights(data: np.ndarray, n: int) -> np.ndarray:
    """The little-endian number in the 8 bytes from each of the first n places; data must reach 7 bytes further."""
    return np.ndarray((n,), "<u8", data, 0, (1,))


#: Which bytes of a last lane count, by how many there are.
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], U)
#: Bytes beyond which a word is hashed by the library instead of lane by lane.
_LONG = 256


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[begin:end]: 8 bytes at a time go through a mixing function, so no words that are made to
    cancel out (as they can under a polynomial modulo 2^64) collide more often than others."""
    size = end - begin
    w = eights(np.concatenate([data, np.zeros(8, np.uint8)]), len(data) + 1)
    h = mix(size.astype(U) * _ODD + U(1))
    live = np.flatnonzero(size <= _LONG)
    at = 0
    while len(live := live[size[live] > at]):
        lane = w[begin[live] + at] & _TAIL[np.minimum(size[live] - at, 8)]
        h[live] = mix(h[live] * _ODD + lane)
        at += 8
    if len(huge := np.flatnonzero(size > _LONG)):
        import xxhash

        h[huge] = [xxhash.xxh3_64_intdigest(data[a:z].tobytes(), 1) for a, z in zip(begin[huge].tolist(), end[huge].tolist(), strict=True)]
    return h


def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each 16 bytes that start at the first n places."""
    w = eights(data, n + 8)
    return mix(mix(w[:n] * _ODD + U(16)) * _ODD + w[8 : n + 8])


#: Primes under 2^31 of the rolling hash and its bases; any numbers in their range do as well. Fixed, so hashes agree.
_PRIMES = (U(2**31 - 1), U(2**31 - 19))
_BASES = (1_390_208_809, 1_902_567_403)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def _power(k: int, inverse: bool, n: int) -> np.ndarray:
    """Powers 0..n of a base (or of its inverse) modulo its prime; made by doubling, kept by the worker."""
    have = _powers.get((k, inverse))
    if have is None or len(have) <= n:
        p = int(_PRIMES[k])
        base = pow(_BASES[k], -1, p) if inverse else _BASES[k]
        have = np.ones(1, np.uint32)
        while len(have) <= n:
            have = np.concatenate([have, (have.astype(U) * U(pow(base, len(have), p)) % U(p)).astype(np.uint32)])
        _powers[k, inverse] = have
    return have[: n + 1]


class Rolling:
    """Hashes of any substring of one byte array, by prefix sums: polynomials modulo two primes, 62 bits together.

    Modulo a prime two different strings of n bytes collide for at most n of its bases, whatever the strings are.
    """

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.up, self.sums = [], []
        for k, p in enumerate(_PRIMES):
            self.up.append(_power(k, False, n))
            sums = np.zeros(n + 1, U)
            np.cumsum((data.astype(U) + U(1)) * _power(k, True, n)[:n] % p, out=sums[1:])  # under 2^31 each: no overflow
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end], elementwise. The power at ``start`` takes the place out, so equal bytes hash alike."""
        one, two = ((sums[end] - sums[start]) % p * up[start] % p for p, up, sums in zip(_PRIMES, self.up, self.sums, strict=True))
        return mix(mix((one << U(32)) | two) + (end - start).astype(U))


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
