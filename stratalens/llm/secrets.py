"""Secret scans: fixed formats, and sliding-window Shannon entropy by character class. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name

#: The base kinds in their order: pattern of a match, least length of what counts, group that is measured. Fixed values.
#: A run of access or hex characters that is too short is passed over whole, so these two ask for the length at once.
BASE = [
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 8, 1),
    ("access", r"AKIA[A-Z0-9]{12,}", 16, 0),
    ("hex", r"[0-9a-f]{32,}", 32, 0),
]
#: What a text must hold for any match of a base kind to count: a cheap test before positions are found.
NEEDS = {
    "assign": r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9+/_.=-]{8}""",
    "access": r"AKIA[A-Z0-9]{12}",
    "hex": r"[0-9a-f]{32}",
}
#: Characters of a candidate string and of the window that slides over it.
CANDIDATE, WINDOW = r"[A-Za-z0-9+/_=-]{20,}", 20
NEEDED = r"[A-Za-z0-9+/_=-]{20}"
#: Character classes of windows: which characters a candidate has, which of them it must have, and the bits a
#: character from which a window counts. The first class that fits is taken.
CLASSES = [
    ("entropy_hex", r"^[0-9a-fA-F]+$", [r"[0-9]", r"[a-fA-F]"], 3.0),
    ("entropy_alnum", r"^[0-9A-Za-z]+$", [r"[0-9]", r"[A-Z]", r"[a-z]"], 3.7),
    ("entropy_base64", r"^[0-9A-Za-z+/_=-]+$", [r"[0-9]", r"[A-Z]", r"[a-z]"], 3.8),
]
#: Candidates that are no secrets as a whole: counters, ids in UUID form.
ALLOW_WHOLE = [r"^[0-9]+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"]
#: Pieces of candidates that are no secrets: placeholders, counting, runs of one character. No capturing groups but the
#: named one, since the pieces are joined to one pattern.
ALLOW = [r"(?i:example|sample|dummy|placeholder|changeme|your[_-])", r"(?<same>.)\k<same>{7,}", r"(?i:0123456789|abcdefghij)"]
#: c log2 c in units of 2^-20 bits, so running sums are whole numbers and don't drift.
_UNIT = 1 << 20
_CLOGC = [0, *(round(c * math.log2(c) * _UNIT) for c in range(1, WINDOW + 1))]


def _let(value: Column, body) -> Column:
    """Bind a value once: a lambda over an array of one."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Parts that one fold handles; folds over longer lists would copy what they have gathered once for each match.
GROUP = 256


def matches(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: leftmost non-overlapping matches, code points from s up to e.

    Matches are fenced by two control characters (their own occurrences are changed first, which no pattern here
    notices); lengths of the parts between fences add up to places. Parts are folded in groups, and groups in turn, so
    the work grows with the text even where a text is full of matches.
    """
    marked = F.regexp_replace(F.translate(text, "\x01\x02", "\x03\x03"), f"({pattern})", "\x01$1\x02")
    none = F.expr("CAST(array() AS array<struct<s:int,e:int,m:string>>)")

    def place(acc, part):
        m = F.substring_index(part, "\x02", 1)
        inside = F.length(m) < F.length(part)
        return F.struct((acc.at + F.length(part) - inside.cast("int")).alias("at"), F.when(inside, F.array_append(acc.out, F.struct(acc.at.alias("s"), (acc.at + F.length(m)).alias("e"), m.alias("m")))).otherwise(acc.out).alias("out"))

    def group(parts):
        return lambda g: F.aggregate(F.slice(parts, g * GROUP + 1, F.lit(GROUP)), F.struct(F.lit(0).alias("at"), none.alias("out")), place)

    def chained(groups):
        begin = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<base:int,out:array<struct<s:int,e:int,m:string>>>>)").alias("out"))
        step = lambda acc, g: F.struct((acc.at + g.at).alias("at"), F.array_append(acc.out, F.struct(acc.at.alias("base"), g.out.alias("out"))).alias("out"))
        moved = lambda g: F.transform(g.out, lambda x: F.struct((x.s + g.base).alias("s"), (x.e + g.base).alias("e"), x.m.alias("m")))
        return F.aggregate(groups, begin, step, lambda x: F.flatten(F.transform(x.out, moved)))

    return _let(F.split(marked, "\x01"), lambda parts: chained(F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / GROUP).cast("int")), group(parts))))


def _clogc(c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in _CLOGC]), c + 1)


#: Windows that one fold slides over; a longer candidate is cut into parts that overlap by a window less one.
PART = 4096
#: Counts of a window by character code, each written as one character; all zero.
_ZERO = "0" * 128


def entropy_runs(s: Column, bits: Column) -> Column:
    """array<struct<s, e>>: maximal runs of s under windows with at least so many bits a character.

    A window's counts by character are carried along: a step takes one character out and one in, and only those two
    terms of the sum of c log2 c change. So the work grows with the length of s, whatever the window.
    """
    most = F.floor((F.lit(math.log2(WINDOW)) - bits) * WINDOW * _UNIT).cast("int")
    none = F.expr("CAST(array() AS array<struct<s:int,e:int>>)")

    def part(lo):
        def runs(chars):
            def move(acc, ch, by):
                """counts and total after one more (or one less) of a character."""
                def changed(at):
                    def put(n):
                        return F.struct((acc.t - _clogc(n) + _clogc(n + by)).alias("t"), F.overlay(acc.n, F.char(n + by + 48), at).alias("n"))

                    return _let(F.ascii(F.substring(acc.n, at, F.lit(1))) - 48, put)

                return _let(F.ascii(ch) + 1, changed)

            def step(acc, i):
                def slid(c):
                    hit = (i >= WINDOW - 1) & (c.t <= most)
                    start = i - (WINDOW - 1)
                    closes = (acc.lo >= 0) & (start > acc.hi)
                    return F.struct(
                        c.t.alias("t"), c.n.alias("n"), F.when(hit & (closes | (acc.lo < 0)), start).when(closes, -1).otherwise(acc.lo).alias("lo"), F.when(hit, i + 1).otherwise(acc.hi).alias("hi"),
                        F.when(closes, F.array_append(acc.out, F.struct(acc.lo.alias("s"), acc.hi.alias("e")))).otherwise(acc.out).alias("out"),
                    )

                rest = F.when(i >= WINDOW, move(acc, F.get(chars, i - WINDOW), -1)).otherwise(F.struct(acc.t.alias("t"), acc.n.alias("n")))
                return _let(_let(rest, lambda c: move(c, F.get(chars, i), 1)), slid)

            begin = F.struct(F.lit(0).alias("t"), F.lit(_ZERO).alias("n"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), none.alias("out"))
            last = lambda x: F.when(x.lo >= 0, F.array_append(x.out, F.struct(x.lo.alias("s"), x.hi.alias("e")))).otherwise(x.out)
            return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 1), begin, step, last)

        found = _let(F.filter(F.split(F.substring(s, lo + 1, F.lit(PART + WINDOW - 1)), ""), lambda x: x != ""), runs)
        return F.transform(found, lambda r: F.struct((r.s + lo).alias("s"), (r.e + lo).alias("e")))

    starts = F.sequence(F.lit(0), F.greatest(F.length(s) - WINDOW, F.lit(0)), F.lit(PART))
    return _let(F.flatten(F.transform(starts, part)), lambda r: F.when(F.size(starts) > 1, _united(r)).otherwise(r))


def _united(runs: Column) -> Column:
    """Runs in order, those that touch joined: the parts of a long candidate meet where they overlap."""
    first = lambda x, i: (i == 0) | (F.get(runs, i - 1).e < x.s)
    ends = F.filter(runs, lambda x, i: (i == F.size(runs) - 1) | (F.get(runs, i + 1).s > x.e))
    return F.zip_with(F.filter(runs, first), ends, lambda a, b: F.struct(a.s.alias("s"), b.e.alias("e")))


def _without(s: Column, e: Column, cuts: Column) -> Column:
    """array<struct<s, e>>: what is left of s..e outside cuts (sorted by start), in pieces of at least a window."""
    begin = F.struct(s.alias("at"), F.expr("CAST(array() AS array<struct<s:int,e:int>>)").alias("out"))

    def step(acc, c):
        return F.struct(F.greatest(acc.at, c.e).alias("at"), F.when(c.s - acc.at >= WINDOW, F.array_append(acc.out, F.struct(acc.at.alias("s"), c.s.alias("e")))).otherwise(acc.out).alias("out"))

    rest = lambda x: F.when(e - x.at >= WINDOW, F.array_append(x.out, F.struct(x.at.alias("s"), e.alias("e")))).otherwise(x.out)
    return F.aggregate(F.filter(cuts, lambda c: (c.e > s) & (c.s < e)), begin, step, rest)


def scan_secrets(docs: DataFrame, text: str = "text", allow: list[str] | None = None) -> DataFrame:
    """docs with secrets: array<struct<s, rank, e, kind>> by start and kind, code points, end exclusive.

    Base kinds are fixed formats. Entropy kinds are runs of windows, within candidate strings of one character class,
    whose Shannon entropy reaches the class's bits. Candidates that are allow-listed as a whole (ALLOW_WHOLE) have none.
    Pieces of a run that match the allow list, and base spans, are cut out of it; what is left of it counts where it is as
    long as a window. ``allow`` replaces the list of pieces. Null text: none. Whole texts are scanned, in time that grows
    with their length; repeated rows get equal results; a column of docs named secrets is replaced.
    """
    keep = [c for c in docs.columns if c.lower() != "secrets"]
    body, base, wide = free_name(docs, "_body", "_base", "_wide")
    kinds = {name: k for k, name in enumerate([b[0] for b in BASE] + [c[0] for c in CLASSES])}
    empty = "CAST(array() AS array<struct<s:int,rank:int,e:int,kind:string>>)"
    t = F.col(body)

    def span(s, e, kind):
        return F.struct(s.alias("s"), F.lit(kinds[kind]).alias("rank"), e.alias("e"), F.lit(kind).alias("kind"))

    def of_kind(kind, pattern, least, group):
        long_enough = F.filter(matches(t, pattern), lambda x: F.length(F.regexp_extract(x.m, pattern, group)) >= least)
        return F.when(t.rlike(NEEDS[kind]), F.transform(long_enough, lambda x: span(x.s, x.e, kind))).otherwise(F.expr(empty))

    found = [of_kind(*b) for b in BASE]
    pieces = "|".join(f"(?:{a})" for a in (ALLOW if allow is None else allow))

    def allowed(run):
        """Allow-listed pieces of a run of a candidate, in its places."""
        return F.transform(matches(run, pieces), lambda a: F.struct(a.s.alias("s"), a.e.alias("e")))

    def kept(x, r):
        run = F.substring(x.m, r.s + 1, r.e - r.s)
        whole = F.array(F.struct(r.s.alias("s"), r.e.alias("e")))
        if not pieces:
            return whole
        cut = F.transform(_let(allowed(run), lambda a: _without(F.lit(0), r.e - r.s, a)), lambda p: F.struct((p.s + r.s).alias("s"), (p.e + r.s).alias("e")))
        return F.when(run.rlike(pieces), cut).otherwise(whole)

    def of_class(x, kind, bits):
        runs = entropy_runs(x.m, F.lit(bits))
        return F.transform(F.flatten(F.transform(runs, lambda r: kept(x, r))), lambda r: span(x.s + r.s, x.s + r.e, kind))

    def entropic(x):
        out = F.expr(empty)
        for kind, only, must, bits in reversed(CLASSES):
            fits = x.m.rlike(only)
            for m in must:
                fits = fits & x.m.rlike(m)
            out = F.when(fits, of_class(x, kind, bits)).otherwise(out)
        for a in ALLOW_WHOLE:
            out = F.when(x.m.rlike(a), F.expr(empty)).otherwise(out)
        return out

    entropy = F.flatten(F.transform(matches(t, CANDIDATE), entropic))
    out = docs.select(*[col(c) for c in keep], F.coalesce(col(text), F.lit("")).alias(body))
    out = out.withColumn(base, F.array_sort(F.concat(*found)))
    out = out.withColumn(wide, F.when(t.rlike(NEEDED), entropy).otherwise(F.expr(empty)))
    touched = lambda w: F.exists(F.col(base), lambda b: (b.s < w.e) & (w.s < b.e))
    split = lambda w: F.transform(_without(w.s, w.e, F.col(base)), lambda p: F.struct(p.s.alias("s"), w.rank.alias("rank"), p.e.alias("e"), w.kind.alias("kind")))
    apart = F.flatten(F.transform(F.col(wide), lambda w: F.when(touched(w), split(w)).otherwise(F.array(w))))
    return out.select(*[col(c) for c in keep], F.sort_array(F.concat(F.col(base), F.when(F.size(wide) > 0, apart).otherwise(F.expr(empty)))).alias("secrets"))


def redacted(docs: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with each secret span of the text replaced by a mask; overlapping spans by one. Null text stays null."""
    found, = free_name(docs, "_secrets")
    t = col(text)

    def cut(acc, x):
        return F.struct(F.when(x.s >= acc.at, F.concat(acc.out, F.substring(t, acc.at + 1, x.s - acc.at), F.lit(mask))).otherwise(acc.out).alias("out"), F.greatest(acc.at, x.e).alias("at"))

    whole = F.aggregate(F.col(found), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), cut, lambda x: F.concat(x.out, F.substring(t, x.at + 1, F.length(t))))
    scanned = scan_secrets(docs, text).withColumnRenamed("secrets", found)
    return scanned.select(*[F.when(F.size(found) > 0, whole).otherwise(t).alias(text) if c == text else col(c) for c in docs.columns if c.lower() != "secrets"])
