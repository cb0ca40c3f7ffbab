"""Public tokenizers over many texts: the library encodes each distinct piece once per worker."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Latin letters that lower-casing and NFC treat one by one, and what may follow them in one piece.
_PLAIN = r"^(?P<a>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<b>[!#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]*)$"
#: Byte-level vocabularies write each byte as a printable character: those outside these three ranges are counted up from 256.
_BYTES = {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF))}
#: Distinct parts of a generation; a worker remembers two, and what is asked for again moves to the newer one. Rare parts
#: are forgotten, results don't change.
REMEMBERED = 300_000


def vocabulary_path(name: str) -> str:
    """Where a public tokenizer file lies; a path to an existing file stays as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


#: The split that pieces take themselves (a fixed value of the file): contractions, words, single digits, runs of marks.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _known_steps(spec: dict) -> bool:
    """Whether the steps before the model are those that pieces rely on: NFC, white space made one space, lower-casing,
    the split above, then bytes. Any other file goes to the library as whole texts."""
    norm = (spec.get("normalizer") or {}).get("normalizers") or []
    replaced = [x for x in norm if x["type"] == "Replace"]
    split, *after = spec["pre_tokenizer"]["pretokenizers"]
    return sorted(x["type"] for x in norm) == ["Lowercase", "NFC", "Replace"] and replaced[0]["pattern"] == {"Regex": r"\s+"} and replaced[0]["content"] == " " and split["pattern"] == {"Regex": _SPLIT} and [x["type"] for x in after] == ["ByteLevel"] and not after[0].get("add_prefix_space")


def _gathered(data: np.ndarray, size: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of data (run k has size[k] entries) in another order, repeats allowed, and where each begins (one entry more)."""
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    count = size[order]
    ends = np.concatenate([[0], np.cumsum(count)])
    return data[np.repeat(begin[order] - ends[:-1], count) + np.arange(ends[-1])], ends


class Pieces:
    """Ids of texts under one tokenizer file, as little-endian unsigned words.

    A tokenizer that drops white space before it splits (word_bpe) gives a text the ids of its space- or
    newline-separated pieces, one after another: NFC doesn't join across a space, its pattern never spans one and its
    special strings hold none. So pieces are encoded once and remembered. Other files go to the library as whole texts.
    """

    def __init__(self, name: str):
        path = vocabulary_path(name)
        self.is_model = path.endswith(".model")
        self.dropping = False
        if self.is_model:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.sp.get_piece_size()
        else:
            from tokenizers import Tokenizer

            self.lib = Tokenizer.from_file(path)
            self.lib.no_truncation()
            self.lib.no_padding()
            self.size = self.lib.get_vocab_size(with_added_tokens=True)
            with open(path, encoding="utf-8") as f:
                spec = json.load(f)
            steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
            self.dropping = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert")) and spec.get("post_processor") is None and _known_steps(spec) and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.code = [i.to_bytes(self.kind.itemsize, "little") for i in range(self.size)]
        self.stems: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        if self.is_model:
            return [np.asarray(x, self.kind).tobytes() for x in self.sp.encode(texts, num_threads=1)]
        return [np.asarray(x.ids, self.kind).tobytes() for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of lower-case Latin letters: each is one pre-token, so the model takes it without the steps before."""
        tokenize, code = self.lib.model.tokenize, self.code
        return [b"".join([code[t.id] for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES))]) for w in words]

    def _stems(self, parts: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """Ids of some distinct parts of pieces; those that this worker hasn't met are encoded."""
        if len(self.stems) > REMEMBERED:
            self.older, self.stems = self.stems, {"": b""}
        stems, older, new = self.stems, self.older, []
        for x in parts:
            if x not in stems:
                if x in older:
                    stems[x] = older[x]
                else:
                    new.append(x)
        for lo in range(0, len(new), 4096):
            some = new[lo : lo + 4096]
            stems.update(zip(some, encode(some), strict=True))
        return list(map(stems.__getitem__, parts))

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty), one text after another, and where each text's begin (one entry more).

        Arrow tells a batch's distinct pieces, and their letters and what follows them where taking these apart is exact;
        Python sees each distinct part, and numpy puts the ids in order.
        """
        texts, width = pc.fill_null(texts, ""), self.kind.itemsize
        if not self.dropping:
            each = self._library(texts.to_pylist())
            return np.frombuffer(b"".join(each), self.kind), np.concatenate([[0], np.cumsum([len(x) // width for x in each])]).astype(np.int64)
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        two = pc.extract_regex(coded.dictionary, _PLAIN)
        words = pc.utf8_lower(pc.fill_null(pc.struct_field(two, 0), "")).dictionary_encode()
        others = pc.if_else(pc.is_null(two), coded.dictionary, pc.fill_null(pc.struct_field(two, 1), "")).dictionary_encode()
        known = self._stems(words.dictionary.to_pylist(), self._words)
        known += self._stems(others.dictionary.to_pylist(), self._library)
        size = np.fromiter(map(len, known), np.int64, len(known)) // width
        parts = np.stack([np.asarray(words.indices, np.int64), len(words.dictionary) + np.asarray(others.indices, np.int64)], 1)
        data, ends = _gathered(np.frombuffer(b"".join(known), self.kind), size, parts.ravel())
        ids, ends = _gathered(data, np.diff(ends[::2]), np.asarray(coded.indices, np.int64))
        return ids, ends[np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(split)))])]

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, joined bytes of ``kind``."""
        ids, off = self.flat(pa.array(texts, pa.string()))
        return [ids[a:z].tobytes() for a, z in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]

    def starts(self, text: str) -> list[tuple[int, int]]:
        """(character offset, id) of each token, as the library gives them."""
        if self.is_model:
            return [(p.begin, p.id) for p in self.sp.encode(text, return_type="proto").pieces]
        e = self.lib.encode(text, add_special_tokens=False)
        return [(a, i) for (a, _), i in zip(e.offsets, e.ids, strict=True)]


_workers: dict[str, Pieces] = {}


def pieces(name: str) -> Pieces:
    """This worker's encoder for a file; made once, kept between tasks."""
    if name not in _workers:
        _workers[name] = Pieces(name)
    return _workers[name]
