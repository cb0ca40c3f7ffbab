"""Repeated substrings and near-duplicates against brute force."""

import hashlib
import random

import numpy as np
import pytest

from stratalens.llm import minhash as M
from stratalens.llm import suffix_dedup as S

SCHEMA = "doc_id bigint, text string, h string, lo int"


def brute_repeats(texts):
    raw = [(t or "").encode() for t in texts]
    where = {}
    for k, t in enumerate(raw):
        for i in range(len(t) - 199):
            where.setdefault(t[i : i + 200], []).append((k, i))
    hit = [np.zeros(len(t), bool) for t in raw]
    for places in where.values():
        if len(places) > 1:
            for k, i in places:
                hit[k][i : i + 200] = True
    out = []
    for t, m in zip(raw, hit, strict=True):
        kept = bytes(b for b, x in zip(t, m, strict=True) if not x)
        spans = int(np.diff(np.concatenate([[0], m.astype(int)])).clip(0).sum())
        out.append((len(t), int(m.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def fixture_texts():
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(n))
    base = words(120)
    texts = [None, "", "short", "a" * 199, "a" * 200, "b" * 201, "a" * 450, "ab " * 200, "x" + "ab " * 90, base, base, words(90)]
    for k in range(12):  # near copies with one change each
        cut = 30 * k + 5
        texts.append(base[:cut] + "#" * (k % 3 + 1) + base[cut + k % 2 :])
    passage = words(60)
    texts += [words(10 + k) + " " + passage + " " + words(5) for k in range(6)]
    texts += [passage[:230] + words(3), words(3) + passage[40:239] + words(3), words(2) + passage[40:240] + words(1), base[100:299], base[100:300]]
    return texts


@pytest.mark.parametrize("small", [False, True])
def test_repeats_match_brute_force(spark, monkeypatch, small):
    if small:  # pieces of a few windows, groups that don't fit a task
        monkeypatch.setattr(S, "PIECE", 150)
        monkeypatch.setattr(S, "GROUP_BYTES", 3 * (S.LENGTH + S.SPAN))
    texts = fixture_texts()
    df = spark.createDataFrame([(k, t, "own", 1) for k, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in S.without_repeats(df).collect()}
    want = brute_repeats(texts)
    for k, w in enumerate(want):
        r = got[k]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == w, (k, texts[k])
        assert hashlib.sha256(r.kept).hexdigest() == w[3]
    assert sum(w[1] for w in want) > 1000


def test_repeats_edges(spark):
    assert S.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    given = [(1, text), (1, text), (None, text + "!"), (2, text[::-1])]
    rows = S.without_repeats(spark.createDataFrame([(i, t, "", 0) for i, t in given], SCHEMA)).collect()
    want = [(i or 0, w[1]) for (i, _), w in zip(given, brute_repeats([t for _, t in given]), strict=True)]
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == sorted(want) == [(0, 300), (1, 300), (1, 300), (2, 0)]


def test_difference_cover():
    rng = np.random.default_rng(0)
    for alphabet in (1, 2, 4):
        data = rng.integers(97, 97 + alphabet, 1500).astype(np.uint8)
        data[700:1000] = data[100:400]
        starts = np.concatenate([np.arange(0, 500), np.arange(650, 1300)])
        raw = data.tobytes()
        seen = {}
        for s in starts:
            seen.setdefault(raw[s : s + 200], []).append(s)
        want = [len(seen[raw[s : s + 200]]) > 1 for s in starts]
        assert S.repeated_windows(data, starts).tolist() == want


def brute_groups(rows, percent=85):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    rows, k = [], 0

    def put(t):
        nonlocal k
        rows.append((k, t))
        k += 1

    for _ in range(6):
        base = rng.choices(vocab, k=rng.randint(30, 120))
        put(" ".join(base))
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            put("\t".join(w) if rng.random() < 0.3 else " ".join(w).upper())
        # a chain: each link is near, the ends are not
        for _ in range(6):
            base = base[1:] + [rng.choice(vocab)]
            put(" ".join(base))
    for t in (None, "", "  \n", "one two", "ONE two", "two one", "a b c d e", "A B\nC D E", "a b c d f"):
        put(t)
    df = spark.createDataFrame([(i, t, 5, b"x") for i, t in rows], "doc_id bigint, text string, id int, set_key binary")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df).collect())
    want = [(i, n, c, i == c) for i, n, c in brute_groups(rows)]
    assert got == want
    left = M.without_near_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [i for i, _, c, kept in want if kept]


@pytest.mark.parametrize("percent", [50, 80])
def test_bands_follow_threshold(spark, percent):
    """Single pairs just above a threshold below the usual one are linked, and no band count misses more than 1e-6."""
    rng, rows = random.Random(percent), []
    for k in range(60):
        a = [f"{k}x{i}" for i in range(104)]
        b = list(a)
        for i in range(34 if percent == 50 else 14):  # a changed tail: one shingle a word and four more
            b[103 - i] = f"{k}y{rng.random()}"
        while True:  # lengthen what is shared until the pair is just near
            w = len(a)
            same = sum(x == y for x, y in zip(a, b, strict=True)) - 4
            if 100 * same >= percent * (2 * (w - 4) - same):
                break
            a, b = [f"{k}z{w}", *a], [f"{k}z{w}", *b]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
    want = brute_groups(rows, percent)
    assert all(c == i - i % 2 for i, _, c in want)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in M.near_duplicates(df, percent=percent).collect()) == want
    for p in (10, 50, 80, 85, 95):
        bands, n = M.banding(p)
        assert (1 - (p / 100) ** n) ** bands <= 1e-6
    assert M.banding(85) == (64, 10)


def test_near_duplicate_edges(spark):
    schema = "doc_id bigint, text string"
    assert M.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = M.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (9, "A b c d e f"), (7, "a b c d e f"), (None, None)], schema)).collect()
    assert sorted(((r.doc_id or 0), r.component_id or 0, r.kept) for r in rows) == [(0, 0, True), (0, 7, False), (7, 7, True), (7, 7, True), (9, 7, False)]


def test_signatures_estimate_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 2**63, 40).astype(np.uint64)])
    h = np.concatenate([np.sort(a), np.sort(b)])
    sig = M.signatures(h, np.array([0, 400, 800]), 2048)
    assert abs((sig[0] == sig[1]).mean() - 360 / 440) < 0.05
    small = M.signatures(np.sort(a[:3]), np.array([0, 3]), 252)
    assert set(small[0].tolist()) <= set(M.mix(a[:3]).tolist()) and len(set(small[0].tolist())) == 3


def test_hashes_do_not_cancel_out():
    """Words and strings built so that a polynomial modulo 2^64 gives them one hash whatever its base."""
    from stratalens.llm import common as C

    w = [0]
    for _ in range(12):
        w += [1 - x for x in w]
    one, two = bytes(97 + x for x in w), bytes(98 - x for x in w)
    for n in (4, 8, 9, 64, 256, 257, 1024, 4096):
        a, b = one[:n], two[:n]
        data, off = C.joined([a, b])
        h, r = C.word_hashes(data, off[:-1], off[1:]), C.Rolling(data).of(off[:-1], off[1:])
        assert h[0] != h[1] and r[0] != r[1], n
    # equal bytes hash alike wherever they lie, long words included
    data = np.frombuffer(b"xx" + one[:700] + b"yyy" + one[:700] + b"z", np.uint8)
    for n in (1, 7, 8, 9, 16, 255, 256, 257, 700):
        at = np.array([2, 705])
        h, r = C.word_hashes(data, at, at + n), C.Rolling(data).of(at, at + n)
        assert h[0] == h[1] and r[0] == r[1], n
    assert C.gram_hashes(data, 700)[2] == C.gram_hashes(data, 710)[705]


def test_built_words_are_not_linked(spark):
    w = [0]
    for _ in range(10):
        w += [1 - x for x in w]
    one, two = "".join("ab"[x] for x in w), "".join("ba"[x] for x in w)
    rows = M.near_duplicates(spark.createDataFrame([(1, one), (2, two)], "doc_id bigint, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows) == [(1, 1), (2, 2)]


def test_recall_at_the_threshold():
    """Pairs at a similarity of exactly the threshold, short sets included: how many share no bucket. None of 20,000."""
    rng = np.random.default_rng(17)
    bands, n_rows = M.banding(85)
    missed = total = 0
    for union in (20, 40, 100, 400):
        same = union * 85 // 100
        for _ in range(10):
            sets, off = [], [0]
            for _ in range(500):
                h = rng.integers(0, 2**63, union).astype(np.uint64)
                half = (union - same) // 2
                for s in (h[: same + half], np.concatenate([h[:same], h[same + half :]])):
                    sets.append(np.sort(s))
                    off.append(off[-1] + len(s))
            keys = M.band_keys(M.signatures(np.concatenate(sets), np.array(off), bands * n_rows), n_rows)
            missed += int((~(keys[::2] == keys[1::2]).any(1)).sum())
            total += 500
    assert total == 20_000 and missed == 0


def test_repeated_ids_do_not_depend_on_partitions(spark):
    rng = random.Random(21)
    texts = [" ".join(rng.choices("abcdefgh", k=40)) for _ in range(6)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (3, texts[0] + " tail"), (4, texts[2]), (4, texts[3]), (5, texts[3])]
    want = None
    for k in range(3):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(k + 1)
        got = sorted((r.doc_id, r.component_id, r.n_shingles) for r in M.near_duplicates(df).collect())
        want = want or got
        assert got == want


def test_near_misses_are_compared_once(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(10**6)}" for _ in range(250)]
    texts = []
    for k in range(60):  # any two share about 0.83 of their shingles, under the threshold
        words = list(base)
        for at in rng.sample(range(0, 250, 6), 2):
            words[at] = f"x{k}-{at}"
        texts.append(" ".join(words))
    made = []
    confirmed = M._confirmed
    monkeypatch.setattr(M, "_confirmed", lambda edges, *more: made.extend((r.a, r.b) for r in edges.collect()) or confirmed(edges, *more))
    M.near_duplicates(spark.createDataFrame([(k, t, "", 0) for k, t in enumerate(texts)], SCHEMA), percent=88).collect()
    assert len(made) == len(set(made)) <= 60 * 59 // 2
