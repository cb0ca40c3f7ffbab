"""Token counts and the store against the library; mixing against brute force."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratalens.llm import token_counts as C
from stratalens.llm import token_store as T
from stratalens.llm.common import new_path
from stratalens.llm.mixing import mixed, source_rates
from stratalens.llm.pieces import pieces

TEXTS = [None, "", " ", "Hello, World! it's we'll", "a<|endoftext|>b <|startoftext|>", "ÀÉ école ＡＢ ΑΣ İx 日本語 テスト", "tab\tand\x0bodd\x1cspace\r\n", "x " * 3000, "longwordwithoutspaces" * 400, "é" * 3000 + " tail", "a b\n" * 900 + "ünï cödé 😀 " * 50]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, 1, True) for k, t in enumerate(TEXTS)] + [(3, TEXTS[3], 1, True), (None, "null id", 1, False)], "doc_id bigint, text string, row int, over_limit boolean")


def library(name, t):
    enc = pieces(name)
    return np.frombuffer(enc._library([t or ""])[0], enc.kind)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts(docs, name):
    for r in C.token_counts(docs, tokenizer=name, chunk_chars=700, overlap_chars=16, limit=500).collect():
        n = len(library(name, r.text))
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 500), (name, r.text)
    assert C.token_counts(docs.limit(0)).count() == 0 and C.token_counts(docs).count() == docs.count()


def test_splice_keeps_all():
    enc = pieces("word_bpe_49k.json")
    for t in TEXTS[3:]:
        parts = list(C.spliced(enc, t, 500, 8))
        assert "".join(parts) == t and b"".join(enc.ids(parts)) == enc._library([t])[0]
    assert len(list(C.spliced(enc, TEXTS[7], 500, 8))) > 5


def test_store_round_trip(spark, docs):
    path = new_path(spark, "t")
    T.write_store(docs, path)
    got = sorted(T.read_store(spark, path).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    start = 0
    assert len(got) == len(rows)
    for r, d in zip(got, rows, strict=True):
        ids = np.append(library("word_bpe_49k.json", d.text), 1).astype("<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.verified) == (d.doc_id, start, len(ids), zlib.crc32(ids.tobytes()), True)
        start += len(ids)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()
    # a chunk that was tampered with is noticed
    bad = new_path(spark, "bad")
    chunks.selectExpr("digest", "n", "concat(data, X'0100') AS data").write.parquet(f"{bad}/chunks")
    for part in ("recipes", "manifest"):
        spark.read.parquet(f"{path}/{part}").write.parquet(f"{bad}/{part}")
    assert not any(r.verified for r in T.read_store(spark, bad).collect())
    empty = new_path(spark, "e")
    T.write_store(docs.limit(0), empty)
    assert T.read_store(spark, empty).count() == 0


def test_store_altered(spark, docs):
    """Recipes and manifests that were changed are noticed, and counts are those of the ids read."""
    path = new_path(spark, "w")
    T.write_store(docs.where("doc_id IS NOT NULL").repartition(3), path)
    true = {(r.doc_id, r.start): r.n_tokens for r in T.read_store(spark, path).where("verified").collect()}
    assert len(true) == len(TEXTS) + 1
    long_id = spark.read.parquet(f"{path}/recipes").orderBy(F.size("digests").desc()).first().doc_id
    other = F.first("digests").over(Window.orderBy(F.col("doc_id").desc()))

    def altered(recipes=lambda x: x, manifest=lambda x: x):
        bad = new_path(spark, "x")
        spark.read.parquet(f"{path}/chunks").write.parquet(f"{bad}/chunks")
        recipes(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{bad}/recipes")
        manifest(spark.read.parquet(f"{path}/manifest")).write.parquet(f"{bad}/manifest")
        return T.read_store(spark, bad).collect()

    def here(value):
        return F.when(F.col("doc_id") == long_id, value)

    for d in (F.reverse("digests"), F.slice("digests", 1, F.size("digests") - 1), F.concat("digests", "digests"), other):
        rows = altered(lambda x, d=d: x.withColumn("digests", here(d).otherwise(F.col("digests"))))
        assert len(rows) == len(true) and not any(r.verified for r in rows if r.doc_id == long_id)
        assert sum(r.verified for r in rows) == len(true) - 1
    rows = altered(lambda x: x.withColumn("n_ids", F.col("n_ids") + 1))
    assert not any(r.verified for r in rows) and {(r.doc_id, r.start): r.n_tokens for r in rows} == true
    assert not any(r.verified for r in altered(lambda x: x.withColumn("root", F.unhex(F.md5("root")))))
    rows = altered(lambda x: x.where(F.col("doc_id") != long_id))
    part = {r.doc_id: r.part for r in spark.read.parquet(f"{path}/recipes").collect()}
    assert len(rows) < len(true) and not any(r.verified for r in rows if part[r.doc_id] == part[long_id])
    for change in (lambda x: x.withColumn("root", F.unhex(F.md5("root"))), lambda x: x.withColumn("n_docs", F.col("n_docs") + 1), lambda x: x.withColumn("n_ids", F.col("n_ids") + 1), lambda x: x.limit(0), lambda x: x.union(x.selectExpr("part + 100", "n_docs", "n_ids", "root"))):
        rows = altered(manifest=change)
        assert not any(r.verified for r in rows) and {(r.doc_id, r.start): r.n_tokens for r in rows} == true


def test_chunks_follow_content():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 49000, 20000).astype("<u2")
    ends = T.chunk_ends(ids, np.array([0, len(ids)]))
    assert np.diff(np.append(0, ends)).max() <= T.MOST and ends[-1] == len(ids) and len(ends) > 10
    moved = T.chunk_ends(np.concatenate([ids[:300], ids]), np.array([0, 300 + len(ids)]))
    assert len(set((moved - 300).tolist()) & set(ends.tolist())) > len(ends) * 0.8
    assert T.merkle([b"a"]) != T.merkle([b"b"]) and T.merkle([]) and T.merkle([b"a", b"b", b"c"]) != T.merkle([b"a", b"c", b"b"])


def test_mixing(spark):
    rows = [(k if k != 5 else None, f"t{k}", ["big", "big", "big", "small", None][k % 5], 9) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy int")
    rates = {r.source_key: r.rate for r in source_rates(df).collect()}
    n = {"big": 300, "small": 100, None: 100}
    total = sum(math.sqrt(x) for x in n.values())
    for s, x in n.items():
        assert abs(rates[s] - math.sqrt(x) / total * 500 / x) < 1e-12
    import hashlib

    def count(key, rate):
        text = "mix|" + ("\x00" if key is None else str(key)) + "|1"
        u, k, p = int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 16**13, 0, math.exp(-rate)
        cdf = p
        while cdf <= u:
            k += 1
            p *= rate / k
            cdf += p
        return k

    out = mixed(df)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.copy) for r in out.collect())
    want = sorted((i if i is not None else -1, c) for i, _, s, _ in rows for c in range(count(i, rates[s])))
    assert got == want and out.columns == ["doc_id", "text", "source", "copy", "mix_key"]
    assert mixed(df.limit(0)).count() == 0
    only = mixed(df, weights={"small": 1.0}, size=20.0).groupBy("source").count().collect()
    assert [r.source for r in only] == ["small"] and abs(only[0]["count"] - 10000) < 500


def test_other_steps_go_to_the_library(tmp_path):
    """A file with the same split and another normaliser isn't taken apart, so its ids are the library's."""
    import json

    from stratalens.llm.pieces import Pieces, vocabulary_path

    with open(vocabulary_path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    assert Pieces("word_bpe_49k.json").dropping
    spec["normalizer"]["normalizers"] = [x for x in spec["normalizer"]["normalizers"] if x["type"] != "Lowercase"]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    enc = Pieces(str(path))
    text = "Some MIXED Case, it's 42"
    assert not enc.dropping and enc.ids([text])[0] == np.asarray(enc.lib.encode(text, add_special_tokens=False).ids, enc.kind).tobytes()
