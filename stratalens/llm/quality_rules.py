"""Quality rules that vote or abstain; expectation-maximisation weighs them. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, stored
from .secrets import _let

#: Words of a window that counts as repeated.
WINDOW = 8
#: Each rule: its measure, from where (below, above) it votes bad, and within which bounds it votes good.
RULES = [
    ("symbols", "n_symbols / greatest(word_chars, 1)", (None, 0.08), (0.0, 0.02)),
    ("lines", "n_dup_lines / greatest(n_lines, 1)", (None, 0.3), (0.0, 0.1)),
    ("repeats", "n_repeat_words / greatest(n_words, 1)", (None, 0.2), (0.0, 0.05)),
    ("length", "word_chars / greatest(n_words, 1)", (2.5, 14.0), (3.5, 10.0)),
    ("stops", "n_stops / greatest(n_words, 1)", (0.01, 0.9), (0.03, 0.5)),
    ("capitals", "n_capitals / greatest(word_chars, 1)", (None, 0.4), (0.0, 0.15)),
    ("bangs", "n_bangs / greatest(n_words, 1)", (None, 0.3), (0.0, 0.05)),
]
#: Rounds of expectation-maximisation at most, and the change of the prior at which it ends.
ROUNDS, CLOSE = 25, 1e-6


def _repeat_words(hashes: Column) -> Column:
    """Words in windows of WINDOW words that the text has twice or more, the first one's included.

    Windows are compared by 64-bit hashes; only texts with a repeated one are sorted.
    """
    n = F.size(hashes) - (WINDOW - 1)
    windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(*[F.element_at(hashes, i + j) for j in range(WINDOW)]))

    def covered(w):
        def places(s):
            again = F.filter(s, lambda x, k: (F.get(s, k - 1).h == x.h) | (F.get(s, k + 1).h == x.h))
            return F.sort_array(F.transform(again, lambda x: x.i))

        ranked = F.sort_array(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        total = F.aggregate(_let(ranked, places), F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("c")), lambda a, i: F.struct(i.alias("last"), (a.c + F.least(F.lit(WINDOW), i - a.last)).alias("c")), lambda a: a.c)
        return F.when(F.size(F.array_distinct(w)) < F.size(w), total).otherwise(F.lit(0))

    return F.when(n >= 2, _let(windows, covered)).otherwise(F.lit(0))


def text_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stops, n_capitals, n_bangs (bigint).

    Words are runs without space or 09-0D. Null text has none of anything.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stops", "n_capitals", "n_bangs")
    keep = [c for c in docs.columns if c.lower() not in names]
    body, m = free_name(docs, "_body", "_m")
    t = F.col(body)
    words = F.filter(F.split(F.regexp_replace(t, r"[\x09-\x0D]", " "), " "), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w):
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), _let(F.transform(w, lambda x: F.xxhash64(x)), _repeat_words).alias("n_repeat_words"))

    def of_lines(x):
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    out = docs.select(*[col(c) for c in keep], F.coalesce(col(text), F.lit("")).alias(body))
    out = out.select(
        *[col(c) for c in keep],
        F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), F.regexp_count(t, F.lit(r"[#*$%&|<>]")).alias("symbols"), F.regexp_count(t, F.lit(r"[.,;:]")).alias("stops"), F.regexp_count(t, F.lit(r"\p{Lu}")).alias("capitals"), F.regexp_count(t, F.lit("[!]")).alias("bangs")).alias(m),
    )
    where = {"n_words": "w.n_words", "word_chars": "w.word_chars", "n_symbols": "symbols", "n_dup_lines": "l.n_dup_lines", "n_repeat_words": "w.n_repeat_words", "n_lines": "l.n_lines", "n_stops": "stops", "n_capitals": "capitals", "n_bangs": "bangs"}
    return out.select(*[col(c) for c in keep], *[F.col(f"{m}.{where[c]}").cast("bigint").alias(c) for c in names])


def votes() -> list[Column]:
    """For each rule -1 (bad), 0 (abstains) or 1 (good)."""
    out = []
    for _, measure, (below, above), (lo, hi) in RULES:
        x = F.expr(measure)
        bad = (x < below if below is not None else F.lit(False)) | (x > above if above is not None else F.lit(False))
        out.append(F.when(bad, -1).when(x.between(lo, hi), 1).otherwise(0))
    return out


def _odds(prior: float, rates: list[dict[int, tuple[float, float]]]) -> tuple[float, list[dict[int, float]]]:
    """Log odds of good before any vote, and what each rule adds for what it says."""
    return math.log(prior / (1 - prior)), [{v: math.log(r[v][1] / r[v][0]) for v in (-1, 0, 1)} for r in rates]


def _posterior(vote: list[Column], prior: float, rates: list[dict[int, tuple[float, float]]]) -> Column:
    """P(good | votes): prior odds times each rule's odds for what it said."""
    start, says = _odds(prior, rates)
    odds = F.lit(start)
    for v, r in zip(vote, says, strict=True):
        odds = odds + F.when(v == -1, r[-1]).when(v == 1, r[1]).otherwise(r[0])
    return 1 / (1 + F.exp(-odds))


def fit_rules(patterns: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Prior of good, and for each rule how often it says -1, 0, 1 over (bad, good) texts.

    patterns: a row for each combination of votes that occurs, with n; at most 3^rules rows, so they are fetched once and
    expectation-maximisation runs over them on the driver. It starts from rules that mostly vote right.
    """
    prior, rates = 0.8, [{-1: (0.6, 0.05), 0: (0.2, 0.15), 1: (0.2, 0.8)} for _ in names]
    rows = sorted((tuple(r[c] for c in names), r.n) for r in patterns.select(*names, "n").collect())
    for _ in range(rounds if rows else 0):
        start, says = _odds(prior, rates)
        total, good = 0.0, 0.0
        sums = [{v: [0.0, 0.0] for v in (-1, 0, 1)} for _ in names]
        for said, n in rows:
            p = n / (1 + math.exp(-start - sum(s[v] for s, v in zip(says, said, strict=True))))
            total, good = total + n, good + p
            for s, v in zip(sums, said, strict=True):
                s[v][0] += n - p
                s[v][1] += p
        new = (good + 4) / (total + 5)
        rates = [{v: ((s[v][0] + 1) / (total - good + 3), (s[v][1] + 1) / (good + 3)) for v in (-1, 0, 1)} for s in sums]
        done, prior = abs(new - prior) < CLOSE, new
        if done:
            break
    return prior, rates


def rule_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with the measures, base_failed, quality (posterior of good) and kept.

    base_failed: fewer than 20 words, or more than 30 in 100 of them in repeated windows. The rules' votes are counted by
    combination over all documents, expectation-maximisation estimates how often each rule is right, and quality is the
    posterior probability of good under those rates. kept: not base_failed, and quality >= threshold. Null and empty
    texts fail. Repeated rows count as often as they occur and get equal results. An empty table gives an empty one.
    """
    names = free_name(docs, *(f"_vote_{name}" for name, *_ in RULES))
    measured = stored(text_measures(docs.select(*[col(c) for c in docs.columns if c.lower() not in ("base_failed", "quality", "kept")]), text).drop(text), "measures")
    voted = measured.select("*", *[v.alias(n) for v, n in zip(votes(), names, strict=True)])
    patterns = voted.groupBy(*names).agg(F.count("*").alias("n"))  # 3^rules rows at most
    prior, rates = fit_rules(patterns, names)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("quality", _posterior([F.col(n) for n in names], prior, rates)).drop(*names)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
