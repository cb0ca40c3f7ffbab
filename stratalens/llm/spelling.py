"""Spelling variants: words at distance one, found by Levenshtein automata that walk compact tries.

The vocabulary is counted over whole texts, sorted, and cut into shards of neighbouring words. Shards are broadcast,
PASS_BYTES of words at a time; in each pass every word's automaton is intersected with the shards' trie depth-first.
Before its one error the automaton follows the word; at the first letter where the trie leaves the word the error is
spent (a letter replaced, inserted or deleted), and from then on only the rest of the word is accepted. So each neighbour
is met once, and branches that can't accept are left at once. What a pass finds is reduced to a row for each word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, col, dropped, slices, stored

#: Letters of a word at least, and occurrences.
LETTERS, TIMES = 5, 3
#: UTF-8 bytes of the words of a shard, and of the shards that one pass broadcasts (with 16 more for each word).
SHARD_BYTES, PASS_BYTES = 1 << 20, 8 << 20
#: Words that a task counts before it hands them on, and words that a task looks up.
COUNTED, TASK_WORDS = 200_000, 10_000
#: Characters of a text taken at a time; cuts fall between runs.
PIECE = 1 << 20

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_OTHER = re.compile("[^A-Za-zÀ-ÿ]")


def _pieces(text: str):
    """A long text in parts that cut no run of letters."""
    lo = 0
    while lo < len(text):
        hi = lo + PIECE
        if hi < len(text):
            cut = _OTHER.search(text, hi)
            hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", one_in: int | None = None) -> DataFrame:
    """word, n: runs of letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z lower-cased, of LETTERS letters that
    occur TIMES times. With one_in, the runs of a document whose CRC-32 of ``<id>:<run>`` is a multiple
    of it lose the letter that this number names (modulo their length) first; a null id counts as an empty one."""

    def count(batches):
        total: Counter = Counter()

        def handed():
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for b in slices(batch, 1):
                for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    doc = f"{'' if name is None else name}:".encode()
                    for part in _pieces(body or ""):
                        runs = Counter(r for r in _RUN.findall(part.encode().translate(_LOWER).decode()) if len(r) >= LETTERS)
                        if one_in:
                            start = zlib.crc32(doc)
                            for r, n in runs.items():
                                h = zlib.crc32(r.encode(), start)
                                if h % one_in == 0:
                                    k = h % len(r)
                                    r = r[:k] + r[k + 1 :]
                                    if len(r) < LETTERS:
                                        continue
                                total[r] += n
                        else:
                            total.update(runs)
                        if len(total) >= COUNTED:
                            yield from handed()
                            total.clear()
        if total:
            yield from handed()

    found = arrow_map(docs.select(col(doc_id).cast("string").alias("doc"), col(text).alias("text")), count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= TIMES)


def trie(words: list[str], counts: list[int]) -> dict:
    """Compact trie of sorted words: first letter -> (label, count of the word that ends there or 0, children)."""
    root: dict = {}
    todo = [(0, len(words), 0, root)]
    while todo:
        lo, hi, depth, kids = todo.pop()
        while lo < hi:
            first = words[lo][depth]
            a, z = lo, hi  # the words from lo on with this letter: sorted, so found by halving
            while a + 1 < z:
                m = (a + z) // 2
                a, z = (m, z) if words[m][depth] == first else (a, m)
            one, last = words[lo], words[a]
            n = depth + 1
            while n < len(one) and n < len(last) and one[n] == last[n]:
                n += 1
            ends = len(one) == n
            below: dict = {}
            kids[first] = (one[depth:n], counts[lo] if ends else 0, below)
            if (inner := lo + ends) < z:
                todo.append((inner, z, n, below))
            lo = z
    return root


def _accepts(node: tuple, label: str, rest: str) -> int:
    """After the error: the count of the word if the trie below ``node``, from the rest of its label on, spells ``rest``."""
    _, n, kids = node
    while True:
        if not rest.startswith(label):
            return 0
        rest = rest[len(label) :]
        if not rest:
            return n
        node = kids.get(rest[0])
        if node is None:
            return 0
        label, n, kids = node


def neighbours(kids: dict, word: str) -> list[tuple[str, int]]:
    """Words of the trie that differ from ``word`` by exactly one letter replaced, inserted or deleted, with counts."""
    out = []
    i, size, here = 0, len(word), 0  # the automaton has read word[:i] without an error; here: count of word[:i] in the trie
    while True:
        rest = word[i:]
        if len(rest) == 1 and here:
            out.append((word[:i], here))  # the last letter deleted
        next_ = rest[:1]
        for first, node in kids.items():
            if first == next_:
                continue
            label = node[0][1:]
            if rest and (n := _accepts(node, label, rest[1:])):
                out.append((word[:i] + first + rest[1:], n))
            if n := _accepts(node, label, rest):
                out.append((word[:i] + first + rest, n))
        if not rest:
            return out
        if len(rest) > 1 and rest[1] != next_ and (node := kids.get(rest[1])) and (n := _accepts(node, node[0], rest[1:])):
            out.append((word[:i] + rest[1:], n))
        node = kids.get(next_)
        if node is None:
            return out
        label, here, kids = node
        if rest.startswith(label):
            i += len(label)
            continue
        k = 1  # the trie leaves the word within this label
        while k < len(rest) and k < len(label) and label[k] == rest[k]:
            k += 1
        if k < len(label):
            if k < len(rest) and (n := _accepts(node, label[k + 1 :], rest[k + 1 :])):
                out.append((word[: i + k] + label[k] + rest[k + 1 :], n))
            if n := _accepts(node, label[k + 1 :], rest[k:]):
                out.append((word[: i + k] + label[k] + rest[k:], n))
            if k < len(rest) and (n := _accepts(node, label[k:], rest[k + 1 :])):
                out.append((word[: i + k] + rest[k + 1 :], n))
        return out


def _shards(words: DataFrame) -> DataFrame:
    """shard, bytes, words, counts: runs of neighbouring words in sorted order, of SHARD_BYTES or a single word."""

    def cut(batches):
        some: list[str] = []
        counts: list[int] = []
        size = 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int64()), pa.array([some], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64()))], names=["bytes", "words", "counts"])

        for b in batches:
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = len(w.encode()) + 16
                if some and size + more > SHARD_BYTES:
                    yield made()
                    some, counts, size = [], [], 0
                some.append(w)
                counts.append(n)
                size += more
        if some:
            yield made()

    parts = arrow_map(words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word"), cut, "bytes bigint, words array<string>, counts array<bigint>")
    return stored(parts.withColumn("shard", F.monotonically_increasing_id()), "shards")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of the negated count and the word of the best neighbour) for words with neighbours.

    words: word, n, each word once.
    """
    spark = words.sparkSession
    shards = _shards(words)
    passes: list[list[int]] = []
    room = 0
    for r in shards.select("shard", "bytes").orderBy("shard").toLocalIterator():  # a row for each megabyte of words
        if not passes or room + r.bytes > PASS_BYTES:
            passes.append([])
            room = 0
        passes[-1].append(r.shard)
        room += r.bytes
    spread = stored(words.select("word").repartition(max(2 * spark.sparkContext.defaultParallelism, -(-words.count() // TASK_WORDS))), "lookups")
    found = None
    for some in passes:
        rows = shards.where(F.col("shard").isin(some)).select("words", "counts").collect()  # PASS_BYTES at most
        model = spark.sparkContext.broadcast([(r.words, r.counts) for r in rows])

        def look(batches, model=model):
            tries = None
            for b in batches:
                if tries is None:
                    tries = [trie(*shard) for shard in model.value]
                    top: dict = {}
                    for t in tries:  # shards of neighbouring words: only the letter at a border is shared
                        for first, node in t.items():
                            top.setdefault(first, []).append(node)
                    # letters in one shard only form one trie; the others stay apart
                    tries = [{f: x[0] for f, x in top.items() if len(x) == 1}, *({f: node} for f, x in top.items() if len(x) > 1 for node in x)]
                out = []
                for w in b.column(0).to_pylist():
                    near = [x for t in tries for x in neighbours(t, w)]
                    if near:
                        best = min(near, key=lambda x: (-x[1], x[0]))
                        out.append((w, len(near), best[1], best[0]))
                w, k, n, best = zip(*out, strict=True) if out else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())], names=["word", "n_near", "form_n", "form"])

        part = stored(arrow_map(spread, look, "word string, n_near bigint, form_n bigint, form string"), "near")
        model.unpersist()
        found = part if found is None else found.unionByName(part)
    dropped(shards)
    if found is None:
        found = spark.createDataFrame([], "word string, n_near bigint, form_n bigint, form string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("minus_n"), F.col("form").alias("form"))).alias("best"))


def followed(links: DataFrame) -> DataFrame:
    """word, root: the last word that links (word -> form) lead to, by pointer doubling: paths halve with each round.

    Links must not run in circles.
    """
    at = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = stored(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        dropped(at)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new.select("word", "root")
        at._scratch = new.__dict__.pop("_scratch")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", one_in: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word of docs (see ``word_counts``).

    n_near counts the words that differ by one letter replaced, inserted or deleted. form is the most frequent of them
    (ties: the smallest in code-point order) if it occurs at least twice as often as the word, else null with form_n.
    root is where forms lead to in the end, the word itself if it has none; counts double with each step, so there is an
    end. Null and empty texts have no words; repeated rows count as often as they occur; an empty table gives no row.
    Words of any length are handled; other columns aren't read.
    """
    words = stored(word_counts(docs, doc_id, text, one_in), "words")
    best = words.join(near_words(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.form").alias("form"), (-F.col("best.minus_n")).alias("form_n"))
    fits = F.col("form_n") >= 2 * F.col("n")
    best = stored(best.select("word", "n", "n_near", F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n")), "variants")
    dropped(words)
    roots = followed(best.where("form IS NOT NULL").select("word", "form"))
    return best.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
