"""Hard negatives, spelling variants and repeated passages against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stratalens.llm import hard_negatives as H
from stratalens.llm import passages as P
from stratalens.llm import spelling as W
from stratalens.llm.queries import op11_hard_negatives, op12_spelling_variants, op13_passage_dedup

# hard negatives


def brute_negatives(rows, every=100, k=5):
    own = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        own[i] = min(own.get(i, (label, q)), (label, q))
    out = set()
    for a, (la, qa) in own.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(qa, q, strict=False)) for i, (_, q) in own.items() if i != a}
        first = lambda ids: sorted(ids, key=lambda i: (-score[i], i))[:k]
        for p in first(i for i in score if own[i][0] == la):
            for rank, n in enumerate(first(i for i in score if own[i][0] != la and 80 * score[p] <= 100 * score[i] <= 100 * score[p]), 1):
                out.add((a, p, rank, n, score[p], score[n]))
    return out


def vectors(rng, n, dim=6, labels=3):
    rows = []
    for i in range(n):
        v = [rng.choice([-0.5, 0.25, 0.5, 0.7501, 1.0]) for _ in range(dim)]  # few values: many ties
        rows.append((i * 5, rng.randrange(labels), v))
    rows += [(None, 1, [1.0] * dim), (7, None, [1.0] * dim), (11, 1, None), (13, 1, [1.0, None] + [0.5] * (dim - 2)), (17, 1, [float("nan")] * dim), (19, 1, [float("inf")] * dim)]
    rows += [rows[3], rows[20], (100, 2, [9.0] * dim), (300, 0, [0.5]), (305, 1, []), (310, 0, [0.5] * (dim + 2))]
    return rows


NEGATIVES = "vec_id bigint, label int, embedding array<double>, id string, score double"


@pytest.mark.parametrize("small", [False, True])
def test_negatives_match_brute_force(spark, monkeypatch, small):
    if small:  # blocks of two anchors, tiles of a few rows
        for name, value in (("BLOCK_ROWS", 2), ("TILE_ROWS", 2), ("TILE_COLUMNS", 7)):
            monkeypatch.setattr(H, name, value)
    rows = vectors(random.Random(5), 150)
    df = spark.createDataFrame([(*r, "x", 0.0) for r in rows], NEGATIVES)
    got = H.hard_negatives(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert {tuple(r) for r in got.collect()} == brute_negatives(rows)


def test_huge_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i * 50, i % 2, [rng.choice([1.0, 2.0**30, -(2.0**29) + 0.125, 2.0**21]) for _ in range(4)]) for i in range(12)]
    got = {tuple(r)[:4] for r in H.hard_negatives(spark.createDataFrame([(*r, "", 0.0) for r in rows], NEGATIVES)).collect()}
    assert got == {r[:4] for r in brute_negatives(rows)}


def test_states_merge_in_any_order():
    rng = np.random.default_rng(4)
    scores, ids = rng.integers(-3, 3, (4, 300)), np.arange(300)
    want = [sorted(zip((-s).tolist(), ids.tolist(), strict=True))[:5] for s in scores]
    for order in (np.arange(300), rng.permutation(300)):
        best = H.Best(4, 5)
        for lo in range(0, 300, 37):
            part = np.sort(order[lo : lo + 37])
            best.add(np.arange(4), scores[:, part], ids[part])
        assert [[(-a, b) for a, b in zip(s, i, strict=True)] for s, i in zip(best.score.tolist(), best.id.tolist(), strict=True)] == want


def test_products_are_exact():
    a = np.array([[2.0**26, 2.0**26 + 1], [3, -1]])
    assert H.products(a, a).tolist() == [[int(x) for x in r] for r in [[2**52 + (2**26 + 1) ** 2, 3 * 2**26 - 2**26 - 1], [3 * 2**26 - 2**26 - 1, 10]]]


def test_no_anchors_no_rows(spark):
    empty = spark.createDataFrame([], NEGATIVES)
    assert H.hard_negatives(empty).collect() == []
    assert H.hard_negatives(spark.createDataFrame([(100, 1, [1.0], "", 0.0)], NEGATIVES)).collect() == []


# spelling variants


def brute_words(docs, one_in):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    n = Counter()
    for name, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if one_in and h % one_in == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :]


def brute_variants(docs, one_in=97):
    n = brute_words(docs, one_in)
    rows = {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        fits = best is not None and n[best] >= 2 * n[w]
        rows[w] = (n[w], len(close), best if fits else None, n[best] if fits else None)
    root = {}
    for w in n:
        r = w
        while rows[r][2]:
            r = rows[r][2]
        root[w] = r
    return {(w, *rows[w], root[w]) for w in n}


def spelled(rng):
    base = ["hello", "hellos", "hallo", "école", "ecole", "écoles", "aaaaaa", "aaaaaaa", "aaaaab", "bbbbb", "ßtraße", "strasse", "×÷×÷×", "anchor", "anchors", "ancho", "ranchor", "nchor", "archon"]
    chain = ["zzzzz", "zzzzzy", "zzzzzyx", "zzzzzyxw", "zzzzzyxwv"]
    docs = [(None, None), (1, ""), (2, "--- 12 ,;"), (None, "Hello HELLO hello hello"), (3, "aaaaaa" * 40)]
    for k, w in enumerate(chain):
        docs.append((50 + k, " ".join([w] * 3 * 2**k)))
    for k in range(60):
        words = [rng.choice(base) for _ in range(rng.randint(1, 30))]
        words = [x.upper() if rng.random() < 0.2 else x[:-1] if rng.random() < 0.1 else x for x in words]
        docs.append((100 + k, "".join(x + rng.choice([" ", "\n", "-", "1", "ĀĀ", "😀"]) for x in words)))
    return [*docs, docs[-1], docs[-2]]


@pytest.mark.parametrize("small", [False, True])
def test_variants_match_brute_force(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD_BYTES", 60), ("PASS_BYTES", 150), ("COUNTED", 3), ("PIECE", 7)):
            monkeypatch.setattr(W, name, value)
    docs = spelled(random.Random(8))
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in docs], "doc_id bigint, text string, word string, n int")
    for one_in in (97, 5) if not small else (5,):
        got = {tuple(r) for r in W.spelling_variants(df, one_in=one_in).select("word", "n", "n_near", "form", "form_n", "root").collect()}
        assert got == brute_variants(docs, one_in)
        assert max(len(r[0]) for r in got) > 5
    assert W.spelling_variants(df.limit(0)).collect() == []


def test_automata_meet_each_neighbour_once():
    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(1, 7))) for _ in range(600)})
    counts = [3 + k for k in range(len(words))]
    whole = W.trie(words, counts)
    for w in words[::7] + ["", "c", "abcab", "b" * 9]:
        got = W.neighbours(whole, w)
        assert len(got) == len(set(got))
        assert set(got) == {(x, c) for x, c in zip(words, counts, strict=True) if near(w, x)}


def test_long_words_and_deep_tries():
    words = sorted(["a" * k for k in range(1, 3_000)] + ["b" * 200_000, "b" * 199_999])
    kids = W.trie(words, [3] * len(words))
    assert {x for x, _ in W.neighbours(kids, "a" * 2_000)} == {"a" * 1_999, "a" * 2_001}
    assert W.neighbours(kids, "b" * 200_000) == [("b" * 199_999, 3)]


# repeated passages


def brute_passages(docs):
    first = {}
    where = []
    for name, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        d = -(2**63) if name is None else name
        for i in range(len(w) - 19):
            s = tuple(w[i : i + 20])
            first[s] = min(first.get(s, (d, i)), (d, i))
        where.append((name, d, w))
    out = []
    for name, d, w in where:
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] < (d, i):
                gone.update(range(i, i + 20))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((name, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def passage_docs(rng):
    words = lambda n: [rng.choice(["a", "bb", "ccc", "dé", "Ee", "\x00", "..", "w%d" % rng.randrange(400)]) for _ in range(n)]
    base, long = words(90), words(400)
    docs = [None, "", " \t\n", "one two", " ".join(words(19)), " ".join(base), " ".join(base), "\n".join(base[:50]) + "\x0b" + "  ".join(base[50:]), " ".join(["x"] * 60), " ".join(["x", "y", "z"] * 30)]
    for k in range(14):  # near copies that branch off at different words
        near_copy = list(long)
        for _ in range(k % 4):
            near_copy[rng.randrange(400)] = "changed"
        lo = rng.randrange(200)
        docs.append(" ".join(words(rng.randrange(30)) + near_copy[lo : lo + rng.randint(19, 200)] + words(rng.randrange(30))))
    docs += [" ".join(words(5) + long[100:119] + words(5)), " ".join(words(5) + long[100:120] + words(5)), " ".join(long[50:150] * 2), "x" * 3_000 + " " + " ".join(base)]
    out = [(k, t) for k, t in enumerate(docs)]
    rng.shuffle(out)
    return [*out, (None, " ".join(long[20:80])), (out[3][0], out[3][1]), (5, " ".join(long[300:360] + base[10:40])), (None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_passages_match_brute_force(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(P, "PIECE", 40)
        monkeypatch.setattr(P, "BLOCK", 16)
    for seed in (1, 2):
        docs = passage_docs(random.Random(seed))
        df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id bigint, text string, pos int, kept string").repartition(3)
        got = sorted(map(repr, (tuple(r) for r in P.without_passages(df).collect())))
        want = sorted(map(repr, ((n, w, g, s, k if t is not None else "") for (n, w, g, s, k), (_, t) in zip(brute_passages(docs), docs, strict=True))))
        assert got == want


def test_paths_are_few(spark):
    rng = random.Random(9)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(500))
    df = spark.createDataFrame([(k, f"begin{k} {passage} end{k}") for k in range(30)], "doc_id bigint, text string")
    spans = P.repeated_passages(df).collect()
    assert len(spans) == 29 and {(r.lo, r.hi) for r in spans} == {(1, 501)}


def test_run_hashes_and_pieces():
    z = np.random.default_rng(1).integers(0, 2**63, 50).astype(np.uint64)
    for n in (1, 2, 3, 8, 19, 20):
        h = P.run_hashes(np.concatenate([z, z]), n)
        assert len(h) == 100 - n + 1 and (h[: 51 - n] == h[50 : 101 - n]).all() and len(set(h[:50].tolist())) == 50
    assert len(P.run_hashes(z[:5], 8)) == 0
    text = b"ab  cd\n" * 50 + b"x" * 500
    assert b"".join(P.pieces(text)) == text


# the registered queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    at = str(tmp_path_factory.mktemp("tables"))
    docs = [(d, t) for d, t in spelled(rng) + [(1000 + (d or 0), t) for d, t in passage_docs(rng)] if d is not None]
    docs = list({d: (d, t) for d, t in docs}.values())
    spark.createDataFrame([(*d, "en", "s", 0) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    rows = [(i * 10, label, v) for i, (_, label, v) in enumerate(vectors(rng, 80)) if v is None or None not in v]
    spark.createDataFrame([(i, v, label) for i, label, v in rows], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, docs, rows


def test_registered_queries(spark, tables):
    at, docs, rows = tables
    assert {tuple(r) for r in op12_spelling_variants(spark, at).select("word", "n", "n_near", "form", "form_n", "root").collect()} == brute_variants(docs)
    want = {r[:4] for r in brute_passages(docs)}
    assert {tuple(r) for r in op13_passage_dedup(spark, at).collect()} == want
    single = [(i, (label + 1) % 10 if label is not None and i % 7 == 0 else label, None if v is None else [float(np.float32(x)) for x in v]) for i, label, v in rows]
    assert {tuple(r) for r in op11_hard_negatives(spark, at).collect()} == brute_negatives(single)


def test_matrix_of_uneven_rows():
    lists = pa.array([[1.0, 2.0], [], [3.0, 4.0, 5.0]], pa.list_(pa.float64()))
    assert H._matrix(lists, 2).tolist() == [[1, 2], [0, 0], [3, 4]]
