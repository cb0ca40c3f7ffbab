"""Toxicity by class-conditional Kneser-Ney models of the characters of words."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, col, slices, stored

#: Characters of an n-gram, its place at the end of a word included.
ORDER = 5
#: Absolute discount of Kneser-Ney smoothing.
DISCOUNT = 0.75
#: Words of the passages whose length-normalised likelihoods are compared.
PASSAGE = 5
#: Bytes of text scored at a time.
PIECE = 1 << 20

#: The alphabet of words: letters a-z and 0 for any digit. 0 stands for what separates words.
SYMBOLS = 28
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A else 0x30 if 0x30 <= c <= 0x39 else 0x20 for c in range(256))
_CODE = np.zeros(256, np.int32)
_CODE[0x61:0x7B] = np.arange(1, 27)
_CODE[0x30] = 27
_BEYOND = re.compile("[^\x00-\x7f]+")
_spelled: dict[str, str] = {}


def _spell(run: re.Match) -> str:
    """Characters beyond ASCII in the alphabet: Latin letters by their base letters, digits as digits, letters of other
    scripts by two letters that follow from the code point; all else separates words."""
    s = run[0]
    if s in _spelled:
        return _spelled[s]
    out = []
    for c in unicodedata.normalize("NFKD", s):
        kind = unicodedata.category(c)
        if kind == "Mn":
            continue
        if c.isascii():
            out.append(c)
        elif kind[0] == "L":
            c = c.lower()[0]
            out.append(chr(97 + ord(c) // 26 % 26) + chr(97 + ord(c) % 26))
        else:
            out.append("0" if kind == "Nd" else " ")
    if len(_spelled) > 50_000:
        _spelled.clear()
    _spelled[s] = "".join(out)
    return _spelled[s]


def folded(text: str | None) -> bytes:
    """A text in the alphabet, words separated by spaces."""
    if not text:
        return b""
    return (text if text.isascii() else _BEYOND.sub(_spell, text)).encode().translate(_FOLD)


def word_counts(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """word, toxic, ordinary: how often each folded word occurs in either class; counted in each task before the shuffle."""

    def count(batches):
        from collections import Counter

        counts = (Counter(), Counter())

        def rows():
            words = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], names=["word", "toxic", "ordinary"])
            counts[0].clear()
            counts[1].clear()

        for batch in batches:
            for b in slices(batch, 0):
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    counts[int(y == 1)].update(folded(t).split())
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield from rows()
        yield from rows()

    table = arrow_map(labelled.select(col(text).alias("text"), col(label).alias("label")), count, "word string, toxic bigint, ordinary bigint")
    return table.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def ngram_ratios(words: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """gram, weight, ratio: log P_toxic - log P_ordinary of each seen n-gram's last character, and of contexts.

    The highest order counts by class. What it discounts goes to one shared chain of lower orders, built on pooled
    continuation counts (in how many contexts a shorter gram occurs), so an expression too rare for its class is
    smoothed alike in both. Rows with a gram one character short are contexts: the ratio of any character not seen
    after it, whose shared part cancels out.
    """
    padded = F.concat(F.lit("\x02" * (order - 1)), F.col("word"), F.lit("\x03"))
    grams = (
        words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(order)))).alias("gram"), "toxic", "ordinary")
        .groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    )
    grams = stored(grams, "grams")
    # shared chain: lower[m] has gram of m characters and p, its last character's probability after the others
    cont = grams.select(F.substring("gram", 2, order - 1).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    by_length = {order - 1: cont}
    for m in range(order - 2, 0, -1):
        by_length[m] = by_length[m + 1].select(F.substring("gram", 2, m).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    total = by_length[1].agg((F.sum("n") + F.count("*")).alias("total"))
    lower = by_length[1].crossJoin(F.broadcast(total)).select("gram", ((F.col("n") + 1) / F.col("total")).alias("p"))  # one row of totals
    for m in range(2, order):
        own = by_length[m].withColumn("ctx", F.substring("gram", 1, m - 1)).withColumn("rest", F.substring("gram", 2, m - 1))
        ctx = own.groupBy("ctx").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"))
        lower = (
            own.join(ctx, "ctx").join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("q")), "rest")
            .select("gram", ((F.greatest(F.col("n") - discount, F.lit(0.0)) + discount * F.col("kinds") * F.col("q")) / F.col("all")).alias("p"))
        )
    top = grams.withColumn("ctx", F.substring("gram", 1, order - 1)).withColumn("rest", F.substring("gram", 2, order - 1))
    ctx = top.groupBy("ctx").agg(*[f(k) for k in ("toxic", "ordinary") for f in (lambda k: F.sum(k).alias(f"{k}_all"), lambda k: F.count_if(F.col(k) > 0).alias(f"{k}_kinds"))])

    def left(k):  # what a context gives to the shared chain
        return F.when(F.col(f"{k}_all") > 0, discount * F.col(f"{k}_kinds") / F.col(f"{k}_all")).otherwise(F.lit(1.0))

    def p(k):
        seen = F.when(F.col(f"{k}_all") > 0, F.greatest(F.col(k) - discount, F.lit(0.0)) / F.col(f"{k}_all")).otherwise(F.lit(0.0))
        return seen + left(k) * F.col("q")

    seen = top.join(ctx, "ctx").join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("q")), "rest").select("gram", (F.col("toxic") + F.col("ordinary")).alias("weight"), (F.log(p("toxic")) - F.log(p("ordinary"))).alias("ratio"))
    contexts = ctx.select(F.col("ctx").alias("gram"), (F.col("toxic_all") + F.col("ordinary_all")).alias("weight"), (F.log(left("toxic")) - F.log(left("ordinary"))).alias("ratio"))
    return seen.unionByName(contexts)


class Ratios:
    """The model that is broadcast: a cell for every n-gram that the alphabet allows, 28^5 of 2 bytes (34 MB) whatever the
    corpus, so no gram is lost or shares its cell. A gram that was never seen has what its context says of any
    unseen character; under a context that was never seen the classes don't differ."""

    def __init__(self, ratios: DataFrame, order: int):
        at, code = F.lit(0), "\x02abcdefghijklmnopqrstuvwxyz0"
        shift = F.translate("gram", "\x03", "\x02")
        for i in range(order - 1):
            at = at * SYMBOLS + F.instr(F.lit(code), F.substring(shift, i + 1, 1)) - 1
        last = F.when(F.length("gram") == order, F.instr(F.lit(code), F.substring(shift, order, 1)) - 1).otherwise(-1)
        # a row for each context: at most 28^4
        rows = ratios.select(at.cast("int").alias("at"), last.cast("tinyint").alias("last"), F.col("ratio").cast("float").alias("ratio")).groupBy("at").agg(F.collect_list(F.struct("last", "ratio")).alias("of"))

        def pack(batches):
            for b in batches:
                of = b.column(1)
                row = np.repeat(np.arange(b.num_rows), np.diff(np.asarray(of.offsets)))
                flat = of.flatten()
                sym, val = np.asarray(flat.field("last"), np.int64), np.asarray(flat.field("ratio"), np.float32)
                cells = np.zeros((b.num_rows, SYMBOLS), np.float32)
                rest = sym < 0
                cells[row[rest]] = val[rest][:, None]
                cells[row[~rest], sym[~rest]] = val[~rest]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.tobytes() for c in cells.astype(np.float16)], pa.binary())], names=["at", "cells"])

        got = arrow_map(rows, pack, "at int, cells binary").toArrow()
        self.order = order
        table = np.zeros((SYMBOLS ** (order - 1), SYMBOLS), np.float16)
        if got.num_rows:
            table[np.asarray(got.column("at"))] = np.frombuffer(b"".join(got.column("cells").to_pylist()), np.float16).reshape(-1, SYMBOLS)
        self.table = table.ravel()

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ratio (log P_toxic - log P_ordinary), length (its end counts) and place of each word of folded text."""
        s = _CODE[np.frombuffer(b" " + text + b" ", np.uint8)]
        word = s > 0
        begin = np.flatnonzero(word[1:] & ~word[:-1]) + 1
        end = np.flatnonzero(word[:-1] & ~word[1:]) + 2  # the place that ends the word counts
        code, inside, unit = s.copy(), np.ones(len(s), bool), 1
        for k in range(1, self.order):
            unit *= SYMBOLS
            inside[k:] &= word[:-k]
            inside[:k] = False
            code[k:] += np.where(inside[k:], s[:-k] * unit, 0)
        sums = np.zeros(len(s) + 1)
        np.cumsum(np.where(word | np.concatenate([[False], word[:-1]]), self.table[code], 0), dtype=float, out=sums[1:])
        return sums[end] - sums[begin], end - begin, begin - 1

    def scores(self, texts: list[str | None], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text the highest ratio of a passage of ``length`` words, a word's share of it; the ratio of the whole
        text, a character's share of it; and its words. Places before and after a text count as words of ratio 0."""
        out, some, size = [], [], 0
        for t in texts:
            t = folded(t)
            if len(t) > PIECE:
                out += [*self._batch(some, length), self._huge(t, length)]
                some, size = [], 0
                continue
            some.append(t)
            size += len(t)
            if size > PIECE:
                out += self._batch(some, length)
                some, size = [], 0
        out += self._batch(some, length)
        passage, whole, words = (np.array(x) for x in zip(*out, strict=True)) if out else (np.zeros(0), np.zeros(0), np.zeros(0))
        return passage, whole, words.astype(np.int64)

    def _batch(self, texts: list[bytes], length: int) -> list[tuple[float, float, int]]:
        if not texts:
            return []
        r, size, begin = self.words(b" ".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        text = np.searchsorted(ends, begin, "right")
        n = np.bincount(text, minlength=len(texts))
        # ``length`` zeros before each text and after the last, so no passage holds words of two
        spread = np.zeros(len(r) + (len(texts) + 1) * length)
        spread[np.arange(len(r)) + (text + 1) * length] = r
        sums = np.concatenate([[0.0], np.cumsum(spread)])
        sums = sums[length:] - sums[:-length]
        starts = np.concatenate([[0], np.cumsum(n + length)[:-1]])
        best = np.maximum.reduceat(sums, starts) / length
        total, chars = np.bincount(text, weights=r, minlength=len(texts)), np.bincount(text, weights=size, minlength=len(texts))
        return list(zip(best.tolist(), (total / np.maximum(chars, 1)).tolist(), n.tolist(), strict=True))

    def _huge(self, text: bytes, length: int) -> tuple[float, float, int]:
        """A huge text in pieces that end with a word; the last words of a piece begin passages of the next."""
        at, best, total, chars, n, tail = 0, 0.0, 0.0, 0, 0, np.zeros(length)
        while at < len(text):
            cut = text.find(b" ", at + PIECE)
            cut = len(text) if cut < 0 else cut
            r, size, _ = self.words(text[at:cut])
            sums = np.concatenate([[0.0], np.cumsum(np.concatenate([tail, r, np.zeros(length if cut == len(text) else 0)]))])
            best = max(best, float((sums[length:] - sums[:-length]).max()))
            tail = np.concatenate([tail, r])[-length:]
            total, chars, n, at = total + float(r.sum()), chars + int(size.sum()), n + len(r), cut
        return best / length, total / max(chars, 1), n


def _logistic(points: list[tuple[float, float, float]], steps: int = 100, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and intercept from a histogram (x, ones, zeros): Newton's method on the likelihood with a light ridge, each
    step halved until it gains."""
    x, one, zero = (np.array(v, float) for v in zip(*points, strict=True)) if points else (np.zeros(1), np.zeros(1), np.ones(1))

    def gain(v):
        z = v[0] * x + v[1]
        return float((one * -np.logaddexp(0, -z) + zero * -np.logaddexp(0, z)).sum() - ridge * (v * v).sum() / 2)

    at = np.array([1.0, -2.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(at[0] * x + at[1], -35, 35)))
        g, w = one - (one + zero) * p, (one + zero) * p * (1 - p)
        grad = np.array([(g * x).sum(), g.sum()]) - ridge * at
        hess = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        step = np.linalg.solve(hess, grad)
        now = gain(at)
        while gain(at + step) < now and abs(step).max() > 1e-9:
            step = step / 2
        at = at + step
        if abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 5, held: int = 0, calibrate: int = 4, passage: int = PASSAGE, order: int = ORDER, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: toxic likelier), predicted (1 if score >= 0.5), passage_ratio, text_ratio,
    n_words: one row for each of docs.

    Both ratios are length-normalised log-likelihoods of the toxic model less those of the ordinary one: text_ratio over
    the characters of the whole text, passage_ratio over the words of its most toxic passage. The score is a logistic
    curve over passage_ratio, since a toxic sentence in a long ordinary text is lost in the whole text's mean.

    Labelled rows are dealt to folds by crc32 of doc_id as text. Fold ``held`` is never learnt from; ``calibrate`` fits
    the logistic curve; all others give the word counts of either class, over their whole texts and whatever their
    number, so the statistics grow with the corpus. Every whole text is scored, huge ones in pieces.
    Null and empty texts have no passage: ratio 0, a low score. A null doc_id counts as held out. Null labels are left
    out; of conflicting labels of a document the highest counts; without labels every ratio is 0. Repeated rows get equal
    rows. Columns of docs other than those named in ``keep`` play no part, whatever their names; those named stay beside
    their row's score.
    """
    fold = F.pmod(F.coalesce(F.crc32(col(doc_id).cast("string").cast("binary")), F.lit(0)), F.lit(folds))
    ids = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"))
    held_back = [f"_keep_{k}" for k in range(len(keep))]
    beside = [(c, x) for c, x in zip(keep, held_back, strict=True) if c != text]  # the text goes to the tasks once
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text"), *[col(c).alias(x) for c, x in beside])
    place = {c: k for k, c in enumerate([doc_id, text, *[c for c, _ in beside]])}
    gold = labels.where(col(label).isNotNull() & col(doc_id).isNotNull()).groupBy(col(doc_id).alias("gold_id")).agg(F.max(col(label)).alias("label"))
    fold_of = F.pmod(F.crc32(F.col("gold_id").cast("string").cast("binary")), F.lit(folds))
    # labels grow with the corpus, so they are never broadcast: one plan at every size
    learn = ids.where(~fold.isin(held, calibrate)).join(gold.where(~fold_of.isin(held, calibrate)).hint("merge"), F.col("doc_id") == F.col("gold_id"))
    model = docs.sparkSession.sparkContext.broadcast(Ratios(ngram_ratios(word_counts(learn, "text", "label"), order), order))

    def score(batches):
        m = model.value
        for batch in batches:
            for b in slices(batch, 1):
                best, whole, n = m.scores(b.column(1).to_pylist(), passage)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best), pa.array(whole), pa.array(n), *(b.column(place[c]) for c in keep)], names=["doc_id", "raw", "whole", "n_words", *held_back])

    kind = docs.schema[doc_id].dataType.simpleString()
    raw = stored(arrow_map(rows, score, ", ".join([f"doc_id {kind}, raw double, whole double, n_words bigint", *[f"{x} {docs.schema[c].dataType.simpleString()}" for c, x in zip(keep, held_back, strict=True)]])), "toxic")
    known = raw.where(fold == calibrate).select("doc_id", "raw").join(gold.hint("merge"), F.col("doc_id") == F.col("gold_id"))
    bins = known.groupBy(F.round(F.greatest(F.least("raw", F.lit(40.0)), F.lit(-40.0)), 2).alias("x")).agg(F.count_if(F.col("label") == 1).alias("one"), F.count_if(F.col("label") != 1).alias("zero"))
    a, b = _logistic([(r.x, r.one, r.zero) for r in bins.orderBy("x").collect()])  # at most 8,001 bins
    score_ = 1 / (1 + F.exp(-(F.lit(a) * F.col("raw") + F.lit(b))))
    held_out = F.pmod(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)), F.lit(folds)) == held
    out = raw.select("doc_id", held_out.alias("held_out"), score_.alias("score"), F.col("raw").alias("passage_ratio"), F.col("whole").alias("text_ratio"), "n_words", *held_back)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passage_ratio", "text_ratio", "n_words", *[F.col(x).alias(c) for c, x in zip(keep, held_back, strict=True)])
