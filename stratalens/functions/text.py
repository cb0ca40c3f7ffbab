"""Scalar text functions as Columns, and the few that shape a query before any data is read."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

CJK = "一-鿿"
QUERY_CJK = CJK + "㐀-䶿"
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cjk_runs(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"([{CJK}]+)"))


def has_cjk(c: Column | str) -> Column:
    return _col(c).rlike(f"[{CJK}]")


def segments(run: Column | str) -> Column:
    """Cut a CJK run at function words, longest first; parts of two characters or more, else the whole run."""
    cut = "|".join(sorted(fixed.FUNCTION_WORDS, key=len, reverse=True))
    parts = F.filter(F.split(_col(run), cut), lambda x: F.length(x) >= 2)
    whole = F.filter(F.array(_col(run)), lambda x: F.length(x) >= 2)
    return F.when(F.size(parts) > 0, parts).otherwise(whole)


def identifiers(c: Column | str) -> Column:
    return F.regexp_extract_all(_col(c), F.lit(f"({IDENTIFIER})"))


def camel_parts(word: Column | str) -> Column:
    """Parts of a camel-case word, and the word itself if there are several."""
    w = _col(word)
    parts = F.regexp_extract_all(w, F.lit(r"([A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+)"))
    return F.when(F.size(parts) > 1, F.concat(parts, F.array(w))).otherwise(parts)


def english_terms(c: Column | str) -> Column:
    """Identifiers and their camel parts, two characters or more, without stop words; first occurrences."""
    stop = F.array(*[F.lit(x) for x in fixed.QUERY_STOP])
    parts = F.flatten(F.transform(identifiers(c), camel_parts))
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 2) & ~F.array_contains(stop, F.lower(p))))


def hunk_tokens(c: Column | str) -> Column:
    """Sorted distinct lower-case identifiers of three characters or more, without code words."""
    stop = F.array(*[F.lit(x) for x in fixed.HUNK_STOP])
    words = F.transform(F.regexp_extract_all(_col(c), F.lit(r"([A-Za-z_$][A-Za-z0-9_$]{2,})")), lambda w: F.lower(w))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w))))


def topic_tokens(c: Column | str) -> Column:
    """Sorted subjects of a statement: identifiers of three characters or more but stop words and hexadecimal ids."""
    stop = F.array(*[F.lit(x) for x in fixed.TOPIC_STOP])
    words = F.regexp_extract_all(_col(c), F.lit(r"([A-Za-z_][A-Za-z0-9_]{2,})"))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: ~F.array_contains(stop, w) & ~w.rlike("^[0-9a-f]{6,}$"))))


def is_specific(token: Column | str) -> Column:
    """Whether a token names something: a capital, an underscore, a digit or a character beyond U+2E80."""
    return _col(token).rlike(r"[\p{Lu}_\d]|[\x{2E81}-\x{10FFFF}]")


def quoted_cjk(c: Column | str, most: int = 5) -> Column:
    """Contents of quoted strings that hold CJK, the first five of a line."""
    found = F.regexp_extract_all(_col(c), F.lit("""['"`]([^'"`]*[""" + CJK + """][^'"`]*)['"`]"""), F.lit(1))
    return F.slice(found, 1, most)


def stable_id(*parts: Column | str, salt: Column | None = None) -> Column:
    """CRC-32 in hex of the parts joined by 0x1f; a salt follows after 0x1e."""
    text = F.concat_ws("\x1f", *[_col(p) for p in parts])
    if salt is not None:
        text = F.concat(text, F.lit("\x1e"), salt)
    return F.lpad(F.lower(F.hex(F.crc32(text.cast("binary")))), 8, "0")


def short_name(qualified: Column | str) -> Column:
    return F.element_at(F.split(_col(qualified), "::"), -1)


def stem(path: Column | str) -> Column:
    """The file's name without its last suffix."""
    return F.regexp_extract(_col(path), r"([^/]+?)(?:\.[^./]*)?$", 1)


def suffix(path: Column | str) -> Column:
    """The last suffix without its dot, lower-case; empty if there is none."""
    return F.lower(F.regexp_extract(_col(path), r"[^/]\.([^./]+)$", 1))


def extension_weight(path: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.EXTENSION_WEIGHTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, suffix(path)), F.lit(fixed.OTHER_EXTENSION_WEIGHT))


def camel_name(c: Column | str) -> Column:
    """Words joined with capital first letters, without leading digits."""
    words = F.filter(F.split(_col(c), r"[^A-Za-z0-9]+"), lambda w: w != "")
    joined = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")
    return F.regexp_replace(joined, "^[0-9]+", "")


def bounded(c: Column | str, head: int = 1500, tail: int = 500) -> Column:
    """A text's head and tail if it is longer than both."""
    t = _col(c)
    return F.when(F.length(t) > head + tail, F.concat(F.left(t, F.lit(head)), F.lit("\n...\n"), F.right(t, F.lit(tail)))).otherwise(t)


def split_clauses(query: Column | str) -> Column:
    """struct<problem, keep>: a query cut at its first keep marker; without one everything is the problem."""
    q = _col(query)
    found = F.filter(F.array(*[F.struct(F.locate(m, q).alias("at"), F.lit(len(m)).alias("n")) for m in fixed.KEEP_MARKERS]), lambda x: x.at > 0)
    best = F.array_min(found)
    return F.struct(
        F.when(F.size(found) > 0, F.substring(q, F.lit(1), best.at - 1)).otherwise(q).alias("problem"),
        F.when(F.size(found) > 0, F.substring(q, best.at + best.n, F.length(q))).otherwise(F.lit("")).alias("keep"),
    )


def domain_hits(blob: Column | str, tokens: Column | None = None) -> Column:
    """map<domain, hits>: triggers that a lower-case text contains, and tokens equal to a trigger; only domains with hits."""
    b = F.lower(_col(blob))
    entries = []
    for name, triggers in fixed.DOMAINS.items():
        n = reduce(lambda x, y: x + y, [F.contains(b, F.lit(t)).cast("int") for t in triggers])
        if tokens is not None:
            n = n + F.size(F.array_intersect(tokens, F.array(*[F.lit(t) for t in triggers])))
        entries.append(F.struct(F.lit(name).alias("key"), n.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.value > 0))


def symbol_pick(query: Column | str) -> Column:
    """The symbol a query names: the first identifier with a capital inside, else the first English term of three
    characters or more, else the longest identifier; null if there is none."""
    ids = identifiers(query)
    inner = F.get(F.filter(ids, lambda w: w.rlike("^.+[A-Z]")), 0)
    term = F.get(F.filter(english_terms(query), lambda w: F.length(w) >= 3), 0)
    longest = F.get(F.sort_array(F.transform(ids, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))), asc=False), 0).w
    return F.coalesce(inner, term, longest)


def json_text(answer: Column | str) -> Column:
    """The JSON in an answer, with or without a code fence around it."""
    a = _col(answer)
    fenced = F.regexp_extract(a, r"(?s)```(?:json)?\s*(.*?)```", 1)
    found = F.when(fenced != "", fenced).otherwise(F.regexp_extract(a, r"(?s)([\{\[].*[\}\]])", 1))
    return F.regexp_replace(found, r"^\s+|\s+$", "")


def query_terms(query: str) -> list[tuple[str, str]]:
    """(term, origin) pairs that a query searches for, in order: CJK segments, dictionary terms inside them, their
    expansions, English words. A query is one short string, so this runs before the plan is made."""
    cut = "|".join(map(re.escape, sorted(fixed.FUNCTION_WORDS, key=len, reverse=True)))
    segs: list[str] = []
    for run in re.findall(f"[{QUERY_CJK}]+", query):
        parts = [p for p in re.split(cut, run) if len(p) >= 2] or [run] * (len(run) >= 2)
        segs += [p for p in parts if p not in segs]
    inside = {s: [zh for zh in fixed.DICTIONARY if zh in s] for s in segs}
    subs = list(dict.fromkeys(zh for found in inside.values() for zh in found))
    out = [(s, f"cjk:{s}") for s in segs] + [(s, f"cjk_sub:{s}") for s in subs]
    for s, found in inside.items():
        words = {w.lower(): w for w in reversed([w for zh in found for w in fixed.DICTIONARY[zh]])}
        out += [(w, f"expand:{s}") for w in sorted(words.values(), key=lambda w: [x for zh in found for x in fixed.DICTIONARY[zh]].index(w))]
    english: list[str] = []
    for w in re.findall(IDENTIFIER, query):
        parts = re.findall(r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+", w)
        for p in [*parts, w] if len(parts) > 1 else parts:
            if p.lower() not in fixed.QUERY_STOP and len(p) >= 2 and p not in english:
                english.append(p)
    return out + [(t, f"en:{t}") for t in english]


def query_vocabulary(query: str, feature: str) -> list[str]:
    """Sorted words for matching change units: the query, its terms, the feature's name and aliases."""
    words = {query, feature.lower(), *(t.lower() for t in fixed.FEATURE_ALIASES.get(feature, []))}
    words |= {t if o.startswith("cjk") else t.lower() for t, o in query_terms(query)}
    return sorted(w for w in words if w)
