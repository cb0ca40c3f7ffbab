"""Secret scan and quality rules against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

from stratalens.llm import secrets as S
from stratalens.llm.quality_rules import rule_quality, text_measures

BASE = [("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 2, 8), ("access", r"AKIA[A-Z0-9]+", 0, 16), ("hex", r"[0-9a-f]+", 0, 32)]

TEXTS = [
    None, "", " \n\t", "token=abcdefgh", 'api_key: "abc.def/123" and APIKEY = \'Zz9-_=+/.\'', "token=short secret:abcdefghij", "password == abcdefgh passwd:token=abcdefgh",
    "AKIAABCDEFGHIJKL AKIASHORT AKIAAKIA12345678901", "x" * 50 + "deadbeef" * 4 + "g" + "0123456789abcdef" * 3, "é😀 Secret='p4ssw0rd99' \x01\x02 tail token=12345678",
    "key kJ8s0Qm2Zp5Vx1Rt7Yw3Lc9Nb4Hd6Fg and 550e8400-e29b-41d4-a716-446655440000", "ExampleToken1234567890abcdefghijABCDEFGHIJ", "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5p6Q7r8" + "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "0F3A9C7E1B5D8F2A6C4E" * 2,
    "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQAAAAAAAAABAAAAMwAAAAtzc2gtZWQyNTUxOQAAACBTkq3VYx7Lw0PzRmJ8Gh",
    "path/Qz7Lw0PzRmJ8GhTkq3VYx/example/Xw9Kd2Nf5Bv8Cm1Zs4Tq7", "kJ8s0Qm2Zp5Vx1Rt7Yw3" + "ab" * 30 + "Lc9Nb4Hd6FgW2eS5dR8t", "Zq8Lw0PzRmJ8GhTkq3VYx token=Qz7Lw0PzRmJ8GhTkq3VYx",
]


def brute_base(t):
    out = []
    for k, (kind, p, g, least) in enumerate(BASE):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(p, t or "") if len(m[g]) >= least]
    return sorted(out)


ALLOW = re.compile(r"(?i:example|sample|dummy|placeholder|changeme|your[_-])|(.)\1{7,}|(?i:0123456789|abcdefghij)")


def outside(a, z, cuts):
    out = []
    for s, e in sorted(cuts):
        if e > a and s < z:
            if s - a >= 20:
                out.append((a, s))
            a = max(a, e)
    return [*out, (a, z)] if z - a >= 20 else out


def brute_entropy(t, base):
    out, names = [], [b[0] for b in S.BASE] + [c[0] for c in S.CLASSES]
    for m in re.finditer(S.CANDIDATE, t or ""):
        s = m[0]
        if any(re.search(a, s) for a in S.ALLOW_WHOLE):
            continue
        for kind, only, must, bits in S.CLASSES:
            if re.search(only, s) and all(re.search(x, s) for x in must):
                h = [-sum(c / 20 * math.log2(c / 20) for c in Counter(s[i : i + 20]).values()) for i in range(len(s) - 19)]
                runs = []
                for i in (i for i, x in enumerate(h) if x >= bits - 1e-7):
                    if runs and i <= runs[-1][1]:
                        runs[-1][1] = i + 20
                    else:
                        runs.append([i, i + 20])
                for a, z in runs:
                    for x, y in outside(a, z, [(a + c.start(), a + c.end()) for c in ALLOW.finditer(s[a:z])]):
                        out += [(x, names.index(kind), y, kind) for x, y in outside(x + m.start(), y + m.start(), [(b[0], b[2]) for b in base])]
                break
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("aAbB09=:' token secret AKIA deadbeef0123\n") for _ in range(300)) for _ in range(20)]
    texts += [f"id {''.join(rng.choices('ABCDEFabcdef0123456789XYZxyz+/', k=rng.randint(15, 60)))} end" for _ in range(60)]
    texts += texts[:5]  # repeated rows
    return spark.createDataFrame([(i if i != 3 else None, t, "x", i) for i, t in enumerate(texts)], "doc_id bigint, text string, secrets string, _body int")


def test_secrets_match_brute_force(docs):
    rows = S.scan_secrets(docs).collect()
    assert len(rows) == docs.count()
    some = 0
    for r in rows:
        base = brute_base(r.text)
        want = sorted(base + brute_entropy(r.text, base))
        got = [(x.s, x.rank, x.e, x.kind) for x in r.secrets]
        assert got == want, r.text
        some += any(x[1] > 2 for x in want)
    assert some > 5


def test_long_strings_in_parts(spark, monkeypatch):
    """Parts of candidates and groups of matches give what whole ones do; a long string takes time in proportion."""
    import time

    rng = random.Random(7)
    mixed = "".join("".join(rng.choices("ABCDEFabcdef0123456789XYZxyz+/", k=rng.randint(20, 50))) + "ab" * rng.randint(0, 20) for _ in range(12))
    texts = [mixed, " ".join(f"token={k:08d}" for k in range(40)), "deadbeef01" * 5 + " " + mixed[:90]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    monkeypatch.setattr(S, "PART", 32)
    monkeypatch.setattr(S, "GROUP", 3)
    for r in S.scan_secrets(df).collect():
        base = brute_base(r.text)
        assert [(x.s, x.rank, x.e, x.kind) for x in r.secrets] == sorted(base + brute_entropy(r.text, base)), r.text
    monkeypatch.undo()
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    long = spark.createDataFrame([(1, "x " + "".join(rng.choices(alphabet, k=1_000_000)))], "doc_id int, text string")
    began = time.time()
    got = S.scan_secrets(long).first().secrets
    assert sum(x.e - x.s for x in got) > 990_000 and time.time() - began < 30


def test_secrets_edges(docs, spark):
    assert S.scan_secrets(docs.limit(0)).count() == 0
    got = S.redacted(spark.createDataFrame([(1, "a token=abcdefgh b"), (2, None), (3, "clean")], "doc_id int, text string")).collect()
    assert [r.text for r in got] == ["a [secret] b", None, "clean"]


def brute_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if wins[tuple(w[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))


def test_measures_match_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \t\x0b\n", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 30, "l1\nl1\n\nl2\n \nl1", "é 😀 #*$%&|<> \r\n\x0c z", "w " * 5000]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "ab\t", "  "]) for _ in range(rng.randint(1, 80))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    for r in text_measures(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(r.text), r.text


def _brute_posteriors(rows):
    """Expectation-maximisation over single documents rather than combinations."""
    from stratalens.llm.quality_rules import CLOSE, ROUNDS, RULES

    def vote(r, measure, bounds, good):
        a, b = re.fullmatch(r"(\w+) / greatest\((\w+), 1\)", measure).groups()
        x = r[a] / max(r[b], 1)
        if bounds[0] is not None and x < bounds[0] or bounds[1] is not None and x > bounds[1]:
            return -1
        return 1 if good[0] <= x <= good[1] else 0

    votes = [[vote(r, m, b, g) for _, m, b, g in RULES] for r in rows]
    prior, rates = 0.8, [{-1: (0.6, 0.05), 0: (0.2, 0.15), 1: (0.2, 0.8)} for _ in RULES]

    def post():
        return [1 / (1 + math.exp(-(math.log(prior / (1 - prior)) + sum(math.log(q[x][1] / q[x][0]) for x, q in zip(v, rates, strict=True))))) for v in votes]

    for _ in range(ROUNDS):
        p = post()
        good, n = sum(p), len(p)
        new = (good + 4) / (n + 5)
        rates = [{x: ((sum(1 - q for q, v in zip(p, votes, strict=True) if v[j] == x) + 1) / (n - good + 3), (sum(q for q, v in zip(p, votes, strict=True) if v[j] == x) + 1) / (good + 3)) for x in (-1, 0, 1)} for j in range(len(RULES))]
        done, prior = abs(new - prior) < CLOSE, new
        if done:
            break
    return post()


def test_rule_quality(spark):
    clean = "The small river ran along the town, and people walked there. " * 1 + " ".join(f"word{i} near" for i in range(30)) + "."
    texts = [clean + str(i) for i in range(30)] + ["SPAM!! " * 40, "a%%% b&&& c*** d$$$ " * 15, "too short", None, ""]
    df = spark.createDataFrame([(i, t, "own", True) for i, t in enumerate(texts)], "doc_id int, text string, quality string, kept boolean")
    rows = sorted(rule_quality(df).collect(), key=lambda r: r.doc_id)
    assert all(r.kept for r in rows[:30]) and not any(r.kept for r in rows[30:])
    for r, p in zip(rows, _brute_posteriors(rows), strict=True):
        assert abs(r.quality - p) < 1e-9
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert rule_quality(df.limit(0)).count() == 0


def test_op6_digest(spark, tmp_path):
    from stratalens.llm.queries import op6_secret_scan

    df = spark.createDataFrame([(1, "x token=abcdefgh " + "a" * 32)], "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    r = op6_secret_scan(spark, str(tmp_path)).first()
    assert (r.n_assign, r.n_access, r.n_hex) == (1, 0, 1)
    assert r.base_sha256 == hashlib.sha256(b"assign:2:16,hex:17:49").hexdigest()
