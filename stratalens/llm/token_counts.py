"""Token counts of whole texts, huge ones included: overlapping chunks, spliced where both encodings agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, col, free_name, slices, stored
from .pieces import Pieces, pieces

#: Texts over this many characters are cut into chunks of about this size.
CHUNK_CHARS = 65_536
#: Characters that neighbouring chunks share at first; doubled while no boundary in them is stable.
OVERLAP_CHARS = 256
#: Tokens after a boundary on which both encodings must agree when the tokenizer doesn't drop white space.
AGREE = 16


def stable_boundary(enc: Pieces, text: str, cut: int, overlap: int) -> int | None:
    """The first place at or after ``cut`` where text can be split without changing any token, or None.

    The text around the cut is encoded twice: from ``overlap`` characters before it, and from the cut on. A common
    boundary is one where both have a token starting and agree on all that follows up to the end of the overlap. It is
    proven if white space precedes it under a tokenizer that drops white space; for others ``AGREE`` equal tokens must
    follow, and the halves encoded apart must give the tokens of the whole. Widened by doubling; None if the text ends first.
    """
    while cut + overlap < len(text):
        lo, hi = max(0, cut - overlap), cut + overlap
        left = [(a + lo, i) for a, i in enc.starts(text[lo:hi])]
        right = [(a + cut, i) for a, i in enc.starts(text[cut:hi])]
        a, b = len(left), len(right)
        while a and b and left[a - 1] == right[b - 1]:
            a, b = a - 1, b - 1
        for place, k in ((right[k][0], k) for k in range(b, len(right))):
            if enc.dropping:
                if place > cut and text[place - 1] in " \n":
                    return place
            elif place > cut and len(right) - k >= AGREE and enc.ids([text[lo:place], text[place:hi]]) == _halves(enc, text[lo:hi], a_ids=[i for x, i in left if x < place]):
                return place
        overlap *= 2
    return None


def _halves(enc: Pieces, text: str, a_ids: list[int]) -> list[bytes]:
    whole, = enc.ids([text])
    n = len(a_ids) * enc.kind.itemsize
    return [whole[:n], whole[n:]]


def spliced(enc: Pieces, text: str, chunk: int, overlap: int) -> Iterator[str]:
    """Parts of a text whose tokens, one part after another, are the text's."""
    begin, cut = 0, chunk
    while cut < len(text):
        place = stable_boundary(enc, text, cut, overlap)
        if place is None:
            break
        yield text[begin:place]
        begin, cut = place, place + chunk
    yield text[begin:]


def token_counts(docs: DataFrame, text: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int | None = 2048, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """docs with n_bytes, n_tokens (bigint) and, if a limit is given, over_limit (n_tokens > limit).

    Texts up to ``chunk_chars`` are counted where they lie. Longer ones are cut at proven stable boundaries into parts,
    the parts are dealt over all tasks, and their counts summed: no task encodes a huge text alone.
    Null text: 0 bytes and tokens. Repeated rows stay apart, each with its own count. Columns of docs that are named like
    a result are replaced; an empty table gives an empty result.
    """
    row, part, n_tok, n_byt = free_name(docs, "row", "part", "n_tok", "n_byt")
    kept = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    base = docs.select(*[col(c) for c in kept], F.octet_length(F.coalesce(col(text), F.lit(""))).cast("bigint").alias(n_byt))
    long_one = F.coalesce(F.length(col(text)), F.lit(0)) > chunk_chars
    short = _counted(base.where(~long_one), text, n_tok, tokenizer)
    # rows of huge texts get a number, so repeated rows stay apart; they are written with it, since both the parts and the
    # join below refer to it and a second reading may number rows anew
    huge = stored(base.where(long_one).withColumn(row, F.monotonically_increasing_id()), "huge")

    def cut(batches):
        enc = pieces(tokenizer)
        for b in batches:
            for r in range(b.num_rows):
                parts = list(spliced(enc, b.column(1)[r].as_py(), chunk_chars, overlap_chars))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()] * len(parts), pa.int64()), pa.array(parts, pa.string())], names=[row, part])

    parts = arrow_map(huge.select(row, col(text).alias(part)), cut, f"`{row}` bigint, `{part}` string").repartition(F.xxhash64(row, part))
    sums = _counted(parts, part, n_tok, tokenizer, keep=[row]).groupBy(row).agg(F.sum(n_tok).alias(n_tok))
    both = short.unionByName(huge.drop(col(text)).join(sums, row).drop(row), allowMissingColumns=True) if text not in kept else short.unionByName(huge.join(sums, row).drop(row))
    out = both.select(*[col(c) for c in kept], col(n_byt).alias("n_bytes"), col(n_tok).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit) if limit is not None else out


def _counted(df: DataFrame, text: str, name: str, tokenizer: str, keep: list[str] | None = None) -> DataFrame:
    """The columns of df (or ``keep``) and the number of tokens of its text."""
    keep = df.columns if keep is None else keep
    schema = ", ".join(f"`{c.replace('`', '``')}` {df.schema[c].dataType.simpleString()}" for c in keep) + f", `{name}` bigint"
    at, fields = df.columns.index(text), [df.columns.index(c) for c in keep]

    def count(batches):
        enc = pieces(tokenizer)
        for batch in batches:
            for b in slices(batch, at):
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in fields), pa.array(np.diff(enc.flat(b.column(at))[1]), pa.int64())], names=[*keep, name])

    return arrow_map(df, count, schema)
