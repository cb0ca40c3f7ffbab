"""Toxicity, quality and decontamination on small made-up tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from stratalens.llm import decontaminate as D
from stratalens.llm import quality_crf as Q
from stratalens.llm import toxicity as X

RNG = random.Random(4)
VOCAB = ["".join(RNG.choices("aeioutrnsl", k=RNG.randint(2, 7))) for _ in range(200)]


def prose(rng, n):
    return " ".join(rng.choices(VOCAB, k=n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(600):
        lines = [prose(rng, rng.randint(5, 25)) for _ in range(rng.randint(1, 5))]
        bad, toxic = k % 5 == 0, k % 4 == 1
        if bad:
            lines = [" ".join(w + "%%%" for w in x.upper().split()) for x in lines]
        if toxic:
            w = lines[-1].split()
            w.insert(rng.randrange(len(w)), rng.choice(["zorgface", "zorghead", "wretchling"]))
            lines[-1] = " ".join(w)
        docs.append((k, "\n".join(lines), "x"))
        labels.append((k, int(not bad), int(toxic)))
    docs += [(9001, None, ""), (9002, "", ""), (None, "some words", ""), (9003, " \n ", "")]
    return spark.createDataFrame(docs, "doc_id bigint, text string, label string"), spark.createDataFrame([*labels, (9002, None, None)], "doc_id bigint, quality int, toxic int")


def test_toxicity(corpus, spark):
    docs, labels = corpus
    gold = {r.doc_id: r.toxic for r in labels.collect()}
    rows = X.toxicity_scores(docs, labels).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id in gold and r.doc_id < 9000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert sum(r.predicted == gold[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.predicted == 0 for r in rows if not r.n_words)
    assert X.toxicity_scores(docs.limit(0), labels).count() == 0
    assert all(r.predicted == 0 for r in X.toxicity_scores(docs, labels.limit(0)).collect())


def test_kneser_ney_matches_brute_force(spark):
    words = [("banana", 3, 5), ("bandana", 0, 2), ("zorg", 4, 0), ("a", 1, 1), ("", 1, 0)]
    got = {r.gram: r.ratio for r in X.ngram_ratios(spark.createDataFrame(words, "word string, toxic bigint, ordinary bigint")).collect()}
    n, d = X.ORDER, X.DISCOUNT
    counts = [Counter(), Counter()]
    for w, t, o in words:
        s = "\x02" * (n - 1) + w + "\x03"
        for i in range(len(w) + 1):
            counts[1][s[i : i + n]] += t
            counts[0][s[i : i + n]] += o
    levels = {n: set(counts[0]) | set(counts[1])}
    cont = {}
    for m in range(n - 1, 0, -1):
        cont[m] = Counter(g[1:] for g in levels[m + 1])
        levels[m] = set(cont[m])

    def shared(g):
        m = len(g)
        if m == 1:
            return (cont[1][g] + 1) / (sum(cont[1].values()) + len(cont[1]))
        mates = [x for x in cont[m] if x[:-1] == g[:-1]]
        return (max(cont[m][g] - d, 0) + d * len(mates) * shared(g[1:])) / sum(cont[m][x] for x in mates)

    def p(c, g):
        mates = [x for x in c if x[:-1] == g[:-1] and c[x] > 0]
        total = sum(c[x] for x in mates)
        return shared(g[1:]) if not total else max(c[g] - d, 0) / total + d * len(mates) / total * shared(g[1:])

    for g in levels[n]:
        assert math.isclose(got[g], math.log(p(counts[1], g)) - math.log(p(counts[0], g)), abs_tol=1e-9), g


def test_scores_match_brute_force(spark):
    """Cells of the broadcast table, passages and whole texts against a walk over n-grams, huge texts in pieces."""
    rng = random.Random(12)
    words = [("".join(rng.choices("abcz0", k=rng.randint(1, 6))), rng.randint(0, 5), rng.randint(1, 9)) for _ in range(80)]
    table = X.ngram_ratios(spark.createDataFrame(words, "word string, toxic bigint, ordinary bigint"))
    ratio = {r.gram: r.ratio for r in table.collect()}
    model, n = X.Ratios(table, X.ORDER), X.ORDER

    def word(w):
        s = "\x02" * (n - 1) + w + "\x03"
        grams = [s[i : i + n] for i in range(len(w) + 1)]
        return sum(ratio.get(g, ratio.get(g[:-1], 0.0)) for g in grams)

    def brute(t):
        w = X.folded(t).decode().split()
        r = [0.0] * 5 + [word(x) for x in w] + [0.0] * 5
        return max(sum(r[i : i + 5]) for i in range(len(r) - 4)) / 5, sum(r) / max(sum(len(x) + 1 for x in w), 1), len(w)

    texts = [" ".join(w for w, *_ in rng.choices(words, k=k)) for k in (1, 3, 5, 6, 40, 200)] + [None, "", "--", "É zà 12 abc", "unseen words only", "日本 кот"]
    for piece in (X.PIECE, 150):
        old, X.PIECE = X.PIECE, piece
        got = list(zip(*model.scores(texts, 5), strict=True))
        X.PIECE = old
        for t, g in zip(texts, got, strict=True):
            want = brute(t)
            assert abs(g[0] - want[0]) < 0.02 and abs(g[1] - want[1]) < 0.02 and g[2] == want[2], t
    assert X.folded("Été, STRAẞE №7 x²!") == b"ete  strasse no0 x0 " or X.folded("Été").decode() == "ete"
    assert X.folded("кот").isalpha() and len(X.folded("кот")) == 6


def test_conflicting_labels(spark):
    docs = spark.createDataFrame([(k, f"plain words {k}" if k % 2 else "zorgface words") for k in range(200)], "doc_id bigint, text string")
    labels = [(k, int(k % 2 == 0)) for k in range(200)]
    a = X.toxicity_scores(docs, spark.createDataFrame([*labels, *[(k, 0) for k in range(0, 200, 2)]], "doc_id bigint, toxic int")).orderBy("doc_id").collect()
    b = X.toxicity_scores(docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")).orderBy("doc_id").collect()
    assert [r.predicted for r in a] == [r.predicted for r in b] == [int(k % 2 == 0) for k in range(200)]


def test_quality(corpus, spark):
    docs, labels = corpus
    gold = {r.doc_id: r.quality for r in labels.collect()}
    rows = Q.quality_scores(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in gold and r.doc_id < 9000]
    assert len(held) > 100 and sum(r.predicted == gold[r.doc_id] for r in held) / len(held) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows if r.doc_id is not None)
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
    assert {r.score for r in Q.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_marginals_match_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    lines = np.array([0, 3, 3, 4, 9])
    s, t = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    p, pairs, total = Q.marginals(s, t, lines)
    want = np.zeros(9)
    for lo, hi in zip(lines[:-1], lines[1:], strict=True):
        if hi == lo:
            continue
        z, acc = 0.0, np.zeros(hi - lo)
        for y in itertools.product((0, 1), repeat=hi - lo):
            w = math.exp(sum(s[lo + i, v] for i, v in enumerate(y)) + sum(t[a, b] for a, b in itertools.pairwise(y)))
            z += w
            acc += w * np.array(y)
        want[lo:hi] = acc / z
    assert np.allclose(p, want) and math.isclose(pairs.sum(), 2 + 0 + 4)


@pytest.mark.parametrize("run", [1, 2, 3])
def test_scanned_marginals_match_steps(monkeypatch, run):
    rng = np.random.default_rng(run)
    lines = np.concatenate([[0], np.cumsum([1, 0, 2, 3, 4, 7, 64, 129, 1])])
    s, t = rng.normal(size=(lines[-1], 2)) * 9, rng.normal(size=(2, 2)) * 3
    want = Q.marginals(s, t, lines)
    monkeypatch.setattr(Q, "RUN", run)
    for a, b in zip(Q.marginals(s, t, lines), want, strict=True):
        assert np.allclose(a, b)


def test_pieces_have_the_features_of_whole_texts(monkeypatch):
    rng = random.Random(5)
    texts = [None, "", "\n\n", *["".join(rng.choices(["a", "Bé", " ", "\n", "7", "#", "same same "], k=rng.randint(1, 80))) for _ in range(60)]]
    whole = Q.line_features(texts)
    field = Q.LineField.__new__(Q.LineField)
    field.mean, field.scale, field.weights, field.trans = np.zeros(31), np.ones(31), np.linspace(-1, 1, 31), np.eye(2)
    want = field.quality(whole[0].astype(float), *whole[1:])
    for piece in (1, 7, 30):
        monkeypatch.setattr(Q, "PIECE", piece)
        monkeypatch.setattr(Q, "BLOCK", piece)
        for a, b in zip(Q.line_features(texts), whole, strict=True):
            assert np.array_equal(a, b)
        assert np.allclose(field.quality_of(texts)[0], want)


def brute_hits(text, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    w, hit, got = words(text), set(), set()
    for name, t in items:
        x = words(t)
        k = min(window, len(x))
        for i in range(len(x) - k + 1) if k else ():
            for j in range(len(w) - k + 1):
                if w[j : j + k] == x[i : i + k]:
                    hit |= set(range(j, j + k))
                    got.add(str(name))
    return len(w), len(hit), sorted(got)


@pytest.mark.parametrize("block", [10, 200_000])
def test_decontamination(spark, block):
    rng = random.Random(2)
    small = [f"v{i}" for i in range(4)]
    items = [(k, " ".join(rng.choices(small, k=rng.choice([3, 9, 10, 11, 14, 25])))) for k in range(12)] + [(50, "Rare-Word"), (51, ""), (52, None), (53, "é é"), (54, " ".join(small * 6))]
    docs = [(k, " ".join(rng.choices(small, k=rng.randint(1, 60)))) for k in range(60)] + [(100, None), (101, ""), (102, "x rare word, É é é!"), (103, "V0 v1--v2 V3 " * 7), (103, "plain")]
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id bigint, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    rows = D.benchmark_hits(df, bench, block_words=block).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(r.text, items), r.text
        if r.text:
            assert brute_hits(r.clean, [])[0] == r.n_words - r.n_hit
    assert D.benchmark_hits(df, bench.limit(0)).where("n_hit > 0").count() == 0
    kept = D.decontaminated(df, bench)
    assert kept.columns == df.columns and {r.text for r in kept.where("doc_id = 103").collect()} == {"plain"}
    assert D.benchmark_hits(df.limit(0), bench).count() == 0


def test_line_labels_change_within_documents():
    """Bad documents of which half the lines are fine: those become good, and transitions don't weld a document together."""
    rng = np.random.default_rng(3)
    good, bad = lambda: prose(random.Random(int(rng.integers(1 << 30))), 12), lambda: "@@@ ### %%% BUY " * 4
    texts = ["\n".join(good() for _ in range(6)) for _ in range(80)] + ["\n".join(bad() if i < 6 else good() for i in range(12)) for _ in range(80)]
    y = np.array([1] * 80 + [0] * 80)
    x, size, lines = Q.line_features(texts)
    field = Q.LineField(x.astype(float), size, lines, y, 0.5, np.arange(160) % 4 == 0)
    assert np.abs(field.trans - field.trans.mean()).max() < 3, field.trans
    q = field.quality(x.astype(float), size, lines)
    assert ((q > 0.5) == (y == 1)).mean() > 0.95
    gold = Q._hidden(((x - field.mean) / field.scale) @ field.weights, size, lines, y)
    inside = gold[lines[80] :].reshape(80, 12)
    assert inside[:, 8:].mean() > 0.9 and inside[:, :6].mean() < 0.1 and gold[: lines[80]].all()


def brute_features(text):
    """A line's ten shares, spelled out; neighbours' are the same of the lines before and after."""
    out = []
    for line in (text or "").split("\n"):
        raw = line.encode()
        w = re.findall(rb"[^ \t\r\v\f\0]+", raw)
        if not w:
            continue
        n = len(raw)
        up = sum(65 <= c <= 90 for c in raw) + sum(raw[i - 1] == 0xC3 and 0x80 <= c <= 0x9E for i, c in enumerate(raw) if i)
        low = sum(97 <= c <= 122 for c in raw) + sum(raw[i - 1] == 0xC3 and c >= 0x9F for i, c in enumerate(raw) if i)
        share = lambda chars: sum(c in chars for c in raw) / n  # noqa: B023, E731
        again = sum(a == b for a, b in zip(w, w[1:], strict=False))
        letters = (up + low) / n
        out.append([up / n / max(letters, 1e-6), share(Q._SYMBOLS), share(b"!?"), share(b".,;:"), share(b"0123456789"), again / len(w), len(w) / n, letters, math.log1p(n) / 8, float(len(w) > 3)])
    zero = [0.0] * 10
    return [a + b + c + [1.0] for a, b, c in zip(out, [zero, *out[:-1]], [*out[1:], zero], strict=True)] if out else []


def test_features_and_scores_match_brute_force():
    texts = [None, "", "One two two, THREE!\n\n  \nÉté à 12%\nx", "same same same\t.\r\n@@ ## ab", "end"]
    x, size, lines = Q.line_features(texts)
    want = [brute_features(t) for t in texts]
    assert np.diff(lines).tolist() == [len(w) for w in want]
    assert np.allclose(x, np.array([r for w in want for r in w]), atol=1e-5)
    field = Q.LineField.__new__(Q.LineField)
    rng = np.random.default_rng(1)
    field.mean, field.scale, field.weights, field.trans, field.curve = np.zeros(31), np.ones(31), rng.normal(size=31), rng.normal(size=(2, 2)), (2.0, -1.0)
    import itertools

    q = field.quality(x.astype(float), size, lines)
    for k, w in enumerate(want):
        z = good = 0.0
        weight = size[lines[k] : lines[k + 1]]
        for y in itertools.product((0, 1), repeat=len(w)):
            p = math.exp(sum(np.dot(r, field.weights) * v for r, v in zip(w, y, strict=True)) + sum(field.trans[a, b] for a, b in itertools.pairwise(y)))
            z += p
            good += p * float(np.dot(weight, y))
        assert abs(q[k] - (good / z / weight.sum() if len(w) else 0)) < 1e-5
