"""The pipeline against the same steps in plain Python (the first model's verdicts are taken as given)."""

import hashlib
import math
import random
import zlib

import numpy as np

import corpus_pipeline as P
from stratalens.llm.pieces import pieces
from stratalens.llm.toxicity import toxicity_scores

from .test_dedup import brute_groups
from .test_models import brute_hits, prose


def copies(doc_id, rate):
    u = int(hashlib.md5(f"mix|{doc_id}|1".encode()).hexdigest()[:13], 16) / 16**13
    k, p = 0, math.exp(-rate)
    cdf = p
    while cdf <= u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_pipeline(spark, tmp_path):
    rng = random.Random(6)
    item = prose(rng, 14)
    docs, labels = [], []
    for k in range(240):
        t = prose(rng, rng.randint(30, 60))
        if k % 4 == 1:
            w = t.split()
            w[5] = "zorgface"
            t = " ".join(w)
        if k % 10 == 2 and docs:
            t = docs[-2][1] + " tail"
        if k % 15 == 7:
            t += " " + item
        docs.append((k, t, "en", f"s{0 if k % 3 else k % 7}", len(t)))
        labels.append((k, 1, int(k % 4 == 1)))
    docs.append((240, item, "en", "s0", len(item)))
    frames = {"documents": (docs, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "labels": (labels, "doc_id bigint, quality int, toxic int"), "benchmark": ([(1, item)], "item_id bigint, text string")}
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = sorted((r.doc_id, r.n_tokens, r.ids_crc32, r.verified) for r in P.run(spark, str(tmp_path)).collect())

    bad = {r.doc_id for r in toxicity_scores(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).where("predicted = 1").collect()}
    assert len(bad ^ {k for k, _, t in labels if t}) < 8
    left = [(i, t, s) for i, t, _, s, _ in docs if i not in bad]
    groups = brute_groups([(i, t) for i, t, _ in left])
    left = [x for x, (i, _, c) in zip(left, groups, strict=True) if i == c]
    clean = []
    for i, t, s in left:
        n, hit, _ = brute_hits(t, [(1, item)])
        if hit <= 0.5 * n:
            clean.append((i, t.replace(item.rstrip("."), "").encode() if hit else t.encode(), s))
    assert 240 not in {i for i, _, _ in clean} and any(item.encode() not in t and docs[i][1].endswith(item) for i, t, _ in clean)
    counts = {s: sum(x[2] == s for x in clean) for s in {x[2] for x in clean}}
    total = sum(math.sqrt(n) for n in counts.values())
    enc, want = pieces("word_bpe_49k.json"), []
    for i, t, s in clean:
        ids = np.append(np.frombuffer(enc._library([t.decode()])[0], "<u2"), 1).astype("<u4")
        want += [(i, len(ids), zlib.crc32(ids.tobytes()), True)] * copies(i, math.sqrt(counts[s]) / total * len(clean) / counts[s])
    assert got == sorted(want)
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None


def test_filters_take_rows(spark, tmp_path):
    """Near copies from 0.8 on go, and rows with a repeated or null id are judged one by one in both filters."""
    rng = random.Random(9)
    a, b, c, bad = (prose(rng, 60) for _ in range(4))
    near = " ".join([*a.split()[:54], *"q w e r t y".split()])  # 50 of 62 shingles: 0.806
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    left = P.drop_near_duplicates(spark, frame([(1, a), (2, near), (3, b)]), "")
    assert left.columns == P.COLUMNS and [(r.doc_id, r.text) for r in left.orderBy("doc_id").collect()] == [(1, a), (3, b)]
    left = P.drop_near_duplicates(spark, frame([(5, a), (5, a), (5, b), (None, b), (None, c), (None, c), (4, near), (None, "")]), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(4, near), (5, b), (0, c), (0, "")])

    docs = [(k, prose(rng, 40) if k % 4 else prose(rng, 20) + " zorgface " + prose(rng, 20)) for k in range(240)]
    spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in docs], "doc_id bigint, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bad = " ".join(["zorgface"] * 5)
    left = P.drop_toxic(spark, frame([*docs, (None, c), (None, bad), (999, b), (999, bad)]), str(tmp_path))
    assert left.columns == P.COLUMNS and sorted(r.text for r in left.where("doc_id = 999 OR doc_id IS NULL").collect()) == sorted([b, c])


def test_store_keeps_the_shuffle(spark):
    """start follows the MD5 of seed, doc_id and copy rather than doc_id."""
    rng = random.Random(4)
    rows = [(k, prose(rng, rng.randint(5, 30)), "en", "s0" if k % 5 else "s1", 1) for k in range(60)]
    out = P.mix_sources(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), "")
    n = {}
    for r in out.collect():
        n[r.doc_id] = n.get(r.doc_id, 0) + 1
    want = sorted((hashlib.md5(f"mix|{i}|{c}|order".encode()).hexdigest()[:16], i) for i, k in n.items() for c in range(k))
    got = sorted(P.write_tokens(spark, out, "").collect(), key=lambda r: r.start)
    assert max(n.values()) > 1 and [r.doc_id for r in got] == [i for _, i in want] and all(r.verified for r in got)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
