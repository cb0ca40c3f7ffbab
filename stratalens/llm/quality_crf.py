"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, col, joined, slices, word_hashes
from .toxicity import _logistic

#: The stated bound of the training sample: labelled documents of each class, and lines of each (a run from a hashed place).
SAMPLE, SAMPLE_LINES = 2_000, 200
#: Of so many sampled documents one fits the logistic curve and none of the field.
CURVE = 4
#: Penalty on squared weights, steps of the first fit, and rounds of fitting and labelling hidden lines.
PENALTY, STEPS, ROUNDS = 1e-3, 150, 3
#: Lines of a text that are taken one step at a time; a longer text is scanned by products of matrices.
RUN = 4096
#: Characters of a long text that are read at a time, in whole lines; lines whose features are put together at a time; a
#: line's own features.
PIECE, BLOCK, OWN = 1 << 22, 1 << 16, 10
_SYMBOLS = b"#*$%&|<>{}[]^~=+@_\\"


def _mask(chars: bytes) -> np.ndarray:
    m = np.zeros(256, bool)
    m[np.frombuffer(chars, np.uint8)] = True
    return m


_UPPER, _LOWER, _DIGIT, _SYM, _BANG, _STOP = (_mask(x) for x in (bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), _SYMBOLS, b"!?", b".,;:"))
_SPACE = _mask(b" \t\r\v\f\n\0")


def _pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts and, of those over PIECE characters, runs of whole lines: which text each is of, in lists of some PIECE characters."""
    of, got, size = [], [], 0
    for k, t in enumerate(texts):
        at = 0
        while t and at < len(t):
            end = t.find("\n", at + PIECE) + 1 or len(t)
            of.append(k)
            got.append(t[at:end])
            size, at = size + end - at, end
            if size >= PIECE:
                yield of, got
                of, got, size = [], [], 0
    if got:
        yield of, got


def own_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A line's own features for every line that isn't blank, each line's bytes, and where each text's lines start.

    Features are shares of a line's bytes or words (capitals, symbols, bangs, stops, digits, words equal to the one before,
    bytes a word) and its length. Long texts are read in runs of lines, so memory follows lines rather than bytes.
    """
    own, sizes, text_of = [np.zeros((0, OWN), np.float32)], [np.zeros(0)], [np.zeros(0, np.int64)]
    for of, got in _pieces(texts):
        o, n, t = _own(got)
        own.append(o)
        sizes.append(n)
        text_of.append(np.asarray(of)[t])
    counts = np.bincount(np.concatenate(text_of), minlength=len(texts))
    return np.concatenate(own), np.concatenate(sizes), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def around(own: np.ndarray, lines: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Features of lines lo to hi: their own, those of the line before and of the line after in the same text, and a one."""
    first = np.ones(len(own) + 1, bool)
    first[:-1] = False
    first[lines[:-1]] = True
    x = np.zeros((hi - lo, 3 * OWN + 1), np.float32)
    x[:, :OWN], x[:, -1] = own[lo:hi], 1
    at = np.arange(lo, hi)
    before, behind = ~first[lo:hi], ~first[lo + 1 : hi + 1]
    x[before, OWN : 2 * OWN] = own[at[before] - 1]
    x[behind, 2 * OWN : -1] = own[at[behind] + 1]
    return x


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line that isn't blank and of its neighbours, each line's bytes, and where each text's lines start."""
    own, size, lines = own_features(texts)
    return around(own, lines, 0, len(own)), size, lines


def _own(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own features, bytes and text of each line that isn't blank."""
    data, off = joined([t.encode() for t in texts], 1)
    n = len(data)
    brk = (data == 10) | (data == 0)
    brk[off[1:] - 1] = True
    end = np.flatnonzero(brk)
    start = np.concatenate([[0], end[:-1] + 1])
    space = _SPACE[data]
    word = ~space
    first = word.copy()
    first[1:] &= space[:-1]
    begin = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= space[1:]
    stop = np.flatnonzero(last) + 1
    of = word_hashes(data, begin, stop)
    same = np.zeros(len(begin), bool)
    line = np.searchsorted(end, begin)
    same[1:] = (of[1:] == of[:-1]) & (line[1:] == line[:-1])
    m = len(end)
    words = np.bincount(line, minlength=m).astype(np.float64)
    again = np.bincount(line, weights=same, minlength=m)
    size = (end - start).astype(np.float64)

    def share(mask: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[end] - c[start]) / np.maximum(size, 1)

    after = np.zeros(n, bool)
    after[1:] = data[:-1] == 0xC3  # two-byte Latin letters: 80-9E are capitals
    upper = _UPPER[data] | after & (data >= 0x80) & (data <= 0x9E)
    lower = _LOWER[data] | after & (data >= 0x9F)
    letters = share(upper) + share(lower)
    own = np.stack([share(upper) / np.maximum(letters, 1e-6), share(_SYM[data]), share(_BANG[data]), share(_STOP[data]), share(_DIGIT[data]), again / np.maximum(words, 1), words / np.maximum(size, 1), letters, np.log1p(size) / 8, (words > 3).astype(float)], 1)
    used = words > 0
    text_of = np.searchsorted(off[1:] - 1, end)[used]
    return own[used].astype(np.float32), size[used], text_of


def _steps(scores: np.ndarray, trans: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward, backward messages and expected pairs and log partitions of runs of lines, one step for all runs at once, long ones first."""
    order = np.argsort(-count, kind="stable")
    start, count = start[order], count[order]
    fwd, bwd = np.zeros_like(scores), np.zeros_like(scores)
    fwd[start] = scores[start]
    sizes = [int(np.searchsorted(-count, -t, "left")) for t in range(1, int(count[0]))]  # runs with more than t lines
    for t, k in enumerate(sizes, 1):
        at = start[:k] + t
        fwd[at] = scores[at] + np.logaddexp(fwd[at - 1][:, :1] + trans[0], fwd[at - 1][:, 1:] + trans[1])
    total = np.logaddexp(*fwd[start + count - 1].T)
    pairs = np.zeros((2, 2))
    for t, k in reversed(list(enumerate(sizes, 1))):
        at = start[:k] + t
        z = scores[at] + bwd[at]
        bwd[at - 1] = np.logaddexp(trans[:, 0] + z[:, :1], trans[:, 1] + z[:, 1:])
        pairs += np.exp(fwd[at - 1][:, :, None] + trans + z[:, None, :] - total[:k, None, None]).sum(0)
    back = np.empty_like(total)
    back[order] = total
    return fwd, bwd, pairs, back


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2x2 matrices of logarithms."""
    return np.logaddexp(a[:, :, :1] + b[:, :1, :], a[:, :, 1:] + b[:, 1:, :])


def _scanned(m: np.ndarray) -> np.ndarray:
    """Products of the first k + 1 matrices for each k: halves are scanned first, so depth is logarithmic."""
    if len(m) == 1:
        return m
    even = len(m) // 2 * 2
    half = _scanned(_product(m[0:even:2], m[1:even:2]))
    out = np.empty_like(m)
    out[0], out[1:even:2] = m[0], half
    out[2::2] = _product(half[: len(m[2::2])], m[2::2])
    return out


def _long(scores: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The same of one long text: products of its lines' 2x2 matrices are scanned from both ends, and no step is a line's."""
    m = trans + scores[1:, None, :]
    fwd = np.concatenate([scores[:1], np.logaddexp(*(scores[0][:, None] + _scanned(m)).transpose(1, 0, 2))])
    back = _scanned(m[::-1].transpose(0, 2, 1)).transpose(0, 2, 1)[::-1]
    bwd = np.concatenate([np.logaddexp(back[:, :, 0], back[:, :, 1]), np.zeros((1, 2))])
    total = float(np.logaddexp(*fwd[-1]))
    pairs = np.zeros((2, 2))
    for lo in range(0, len(m), RUN):
        a = slice(lo, lo + RUN)
        pairs += np.exp(fwd[:-1][a][:, :, None] + m[a] + bwd[1:][a][:, None, :] - total).sum(0)
    return fwd, bwd, pairs, total


def marginals(scores: np.ndarray, trans: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over all texts at once: P(good) of each line, expected pairs, log partition of texts with lines.

    scores: each line's log potential of (bad, good); trans: log potentials of neighbouring labels. Texts of up to RUN
    lines go step by step together; a longer one is scanned, in time that grows with its lines.
    """
    count = np.diff(lines)
    fwd, bwd = np.zeros_like(scores), np.zeros_like(scores)
    pairs, total = np.zeros((2, 2)), np.zeros(len(count))
    short = (count > 0) & (count <= RUN)
    if short.any():
        fwd, bwd, pairs, total[short] = _steps(scores, trans, lines[:-1][short], count[short])
    for k in np.flatnonzero(count > RUN):
        a = slice(lines[k], lines[k + 1])
        fwd[a], bwd[a], more, total[k] = _long(scores[a], trans)
        pairs = pairs + more
    both = fwd + bwd
    return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60))), pairs, total[count > 0]


def _fitted(x: np.ndarray, lines: np.ndarray, gold: np.ndarray, par: np.ndarray, steps: int) -> np.ndarray:
    """Weights and transitions by Adam on the penalised log-likelihood of labelled lines, from ``par`` on."""
    m, v = np.zeros_like(par), np.zeros_like(par)
    inner = np.ones(len(gold), bool)
    inner[lines[:-1][np.diff(lines) > 0]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[np.flatnonzero(inner) - 1].astype(int), gold[inner].astype(int)), 1)
    for t in range(1, steps + 1):
        s = np.zeros((len(x), 2))
        s[:, 1] = x @ par[:-4]
        p, pairs, _ = marginals(s, par[-4:].reshape(2, 2), lines)
        grad = np.concatenate([x.T @ (gold - p), (seen - pairs).ravel()]) / max(len(x), 1) - PENALTY * par
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        par = par + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return par


def _hidden(look: np.ndarray, size: np.ndarray, lines: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels of lines by how they look: good ones in good documents; in bad ones the lines that look bad, and the worst
    lines up to half of the bytes."""
    text = np.repeat(np.arange(len(y)), np.diff(lines))
    order = np.lexsort((look, text))
    sums = np.concatenate([[0], np.cumsum(size[order])])
    before = sums[:-1] - sums[lines[:-1]][text[order]]
    total = (sums[lines[1:]] - sums[lines[:-1]])[text[order]]
    bad = np.zeros(len(look), bool)
    bad[order] = before < total / 2
    return np.where(y[text] == 1, 1.0, np.where(bad | (look < 0), 0.0, 1.0))


class LineField:
    """A fitted field: weights of good against bad, transitions, and the logistic curve over document quality."""

    def __init__(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray, y: np.ndarray, prior: float, curve: np.ndarray):
        """Fit on documents' lines; the documents that ``curve`` marks are left out of that and fit the logistic curve.

        Lines of good documents are good. Those of bad documents are hidden: they begin as bad, and after each fit those
        that look good become so, as long as at least half of a document's bytes stay bad (the lines that look worst).
        So labels change within documents, and transitions say how often they do.
        """
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.mean[-1], self.scale[-1] = 0, 1
        x = (x - self.mean) / self.scale
        at = np.repeat(~curve, np.diff(lines))
        own, own_size, counts, own_y = x[at], size[at], np.diff(lines)[~curve], y[~curve]
        own_lines = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        par = np.zeros(x.shape[1] + 4)
        gold = np.repeat(own_y, counts).astype(float)
        for k in range(ROUNDS):
            par = _fitted(own, own_lines, gold, par, STEPS if k == 0 else STEPS // 3)
            gold = _hidden(own @ par[:-4], own_size, own_lines, own_y)
        self.weights, self.trans = par[:-4], par[-4:].reshape(2, 2)
        self.curve = (1.0, 0.0)
        q, known = self.quality(x, size, lines, scaled=True)[curve], y[curve]
        share = np.array([1 - prior, prior]) / np.maximum(np.bincount(known, minlength=2) / max(len(known), 1), 1e-9)
        self.curve = _logistic([(float(a), float(b * share[1]), float((1 - b) * share[0])) for a, b in zip(q, known, strict=True)])

    def quality(self, x: np.ndarray, size: np.ndarray, lines: np.ndarray, scaled: bool = False) -> np.ndarray:
        """Length-weighted mean of P(good) over each text's lines; 0 for a text without any."""
        x = x if scaled else (x - self.mean) / self.scale
        return self._weighed(x @ self.weights, size, lines)

    def quality_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Quality and number of lines of each text; features are put together for BLOCK lines at a time."""
        own, size, lines = own_features(texts)
        look = np.zeros(len(own))
        for lo in range(0, len(own), BLOCK):
            hi = min(lo + BLOCK, len(own))
            look[lo:hi] = (around(own, lines, lo, hi).astype(np.float64) - self.mean) / self.scale @ self.weights
        return self._weighed(look, size, lines), np.diff(lines)

    def _weighed(self, look: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
        s = np.zeros((len(look), 2))
        s[:, 1] = look
        p, _, _ = marginals(s, self.trans, lines)
        c, w = np.concatenate([[0], np.cumsum(p * size)]), np.concatenate([[0], np.cumsum(size)])
        n = w[lines[1:]] - w[lines[:-1]]
        return np.where(n > 0, (c[lines[1:]] - c[lines[:-1]]) / np.maximum(n, 1), 0.0)

    def score(self, quality: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a * quality + b, -35, 35)))


def _fold(c, folds: int):
    return F.pmod(F.coalesce(F.crc32(c.cast("string").cast("binary")), F.lit(0)), F.lit(folds))


def fit_field(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, folds: int, held: int, sample: int) -> LineField | None:
    """Fit on at most ``sample`` labelled documents of each class outside the held-out fold, taken in hash order."""
    gold = labels.where(col(label).isin(0, 1) & col(doc_id).isNotNull() & (_fold(col(doc_id), folds) != held)).groupBy(col(doc_id).alias("gold_id")).agg(F.min(col(label)).cast("int").alias("label"))
    shares = {r.label: r.n for r in gold.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    if not shares.get(0) or not shares.get(1):
        return None
    picked = None
    for y in (0, 1):
        some = gold.where(F.col("label") == y).orderBy(F.xxhash64("gold_id"), "gold_id").limit(sample)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("gold_id"))  # 2 * sample ids

    def features(batches):
        for batch in batches:
            for b in slices(batch, 0):
                own, size, lines = own_features(b.column(0).to_pylist())
                runs = [(lo + h % max(hi - lo - SAMPLE_LINES + 1, 1), hi) for lo, hi, h in zip(lines[:-1].tolist(), lines[1:].tolist(), b.column(3).to_pylist(), strict=True)]
                runs = [(lo, min(hi, lo + SAMPLE_LINES)) for lo, hi in runs]
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([around(own, lines, lo, hi).tobytes() for lo, hi in runs], pa.binary()), pa.array([size[lo:hi].astype(np.float64).tobytes() for lo, hi in runs], pa.binary()), b.column(2), b.column(3)], names=["label", "x", "size", "doc_id", "place"])

    kind = docs.schema[doc_id].dataType.simpleString()
    place = F.xxhash64("doc_id", F.lit("place")) % (1 << 30) + (1 << 30)
    got = arrow_map(rows.select("text", "label", "doc_id", place.alias("place")), features, f"label int, x binary, size binary, doc_id {kind}, place bigint").toArrow().sort_by([("doc_id", "ascending"), ("x", "ascending")])  # bounded by the sample
    wide = 31
    xs = [np.frombuffer(v, np.float32).reshape(-1, wide) for v in got.column("x").to_pylist()]
    lines = np.concatenate([[0], np.cumsum([len(v) for v in xs])]).astype(np.int64)
    if not lines[-1]:
        return None
    size = np.concatenate([np.frombuffer(v, np.float64) for v in got.column("size").to_pylist()])
    y, curve = np.asarray(got.column("label"), np.int64), np.asarray(got.column("place"), np.int64) % CURVE == 0
    if min(len(set(y[curve])), len(set(y[~curve]))) < 2:  # too few for both: the same documents serve twice
        return LineField(np.concatenate([*xs, *xs]).astype(np.float64), np.concatenate([size, size]), np.concatenate([lines, lines[1:] + lines[-1]]), np.concatenate([y, y]), shares[1] / (shares[0] + shares[1]), np.repeat([False, True], len(y)))
    return LineField(np.concatenate(xs).astype(np.float64), size, lines, y, shares[1] / (shares[0] + shares[1]), curve)


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4, held: int = 2, threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: good likelier), predicted (1 if score >= threshold), n_lines.

    The field is fitted on a bounded sample (``sample`` documents of each class, SAMPLE_LINES lines of each) of labelled
    rows outside the held-out fold of crc32(doc_id as text), the curve from quality to score on a part of it that the
    field hasn't seen; of conflicting labels of a document the lowest counts. It labels every line of every whole text, and a document's quality is the mean
    marginal of its lines, weighted by their bytes. Null, empty and blank texts have no lines: quality 0. Without labels
    of both classes every score is 0.5. Null ids aren't held out. Repeated rows get equal rows. Other
    columns of docs play no part, whatever their names. Very long texts are scored whole: they are read in runs of lines and
    their marginals are scanned, so time grows with their bytes and memory with their lines (some 0.3 KB each).
    """
    field = fit_field(docs, labels, doc_id, text, label, folds, held, sample)

    def score(batches):
        for batch in batches:
            for b in slices(batch, 1):
                texts = b.column(1).to_pylist()
                quality, n = (np.zeros(len(texts)), np.diff(own_features(texts)[2])) if field is None else field.quality_of(texts)
                s = np.full(len(texts), 0.5) if field is None else field.score(quality)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(n)], names=["doc_id", "score", "n_lines"])

    kind = docs.schema[doc_id].dataType.simpleString()
    out = arrow_map(docs.select(col(doc_id).alias("doc_id"), col(text).alias("text")), score, f"doc_id {kind}, score double, n_lines bigint")
    return out.select("doc_id", (_fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")
