"""Facts of TypeScript and JavaScript files: symbols, imports, calls, JSX references, UI strings.

Each file is read on its own, so files are read in parallel. A lexer blanks what isn't code (comments, strings, regular
expressions, text between tags) but keeps what templates substitute; brackets are paired once; declarations are found by
patterns, and what they span, what is called and who calls it by the paired brackets.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.functions import fixed

FACT_SCHEMA = "fact string, file string, name string, kind string, line_start int, line_end int, exported boolean, detail string, names array<string>, caller string"
_CJK = re.compile("[一-鿿]")
_NAME = r"[A-Za-z_$\u00C0-\uFFFF][\w$]*"
_PLAIN = re.compile(r"""[^/`'"{}]+""")
_QUOTED = re.compile(r"""\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'""")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TAG_TEXT = re.compile(r">([^<>{}]+)(?=</[A-Za-z>])")
_DECL = re.compile(
    rf"(?<![\w$.])(?P<exp>export\s+)?(?P<default>default\s+)?(?:(?:declare|abstract|async)\s+)*(?:(?P<fn>function)\s*\*?\s*(?P<fname>{_NAME})|(?P<cls>class)\s+(?P<cname>{_NAME})|(?P<var>const|let|var)\s+(?={_NAME}))"
)
_DECLARATOR = re.compile(rf"\s*(?P<name>{_NAME})\s*!?\s*(?::(?P<type>[^=;]+(?:=>[^=;]+)*))?=(?![=>])\s*")
_FUNCTION = re.compile(rf"(?:async\s+)?(?:function\b|(?:<[^>()]*>\s*)?(?=\()|{_NAME}\s*=>)")
_WRAPPER = re.compile(rf"(?:{_NAME}\s*\.\s*)*(?:{'|'.join(fixed.WRAPPERS)})\s*(?:<[^()]*>)?\s*(?=\()")
_METHOD = re.compile(rf"(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*\*?\s*(?P<name>#?{_NAME})\s*(?:<[^>()]*>)?\s*(?=\()")
_IMPORT = re.compile(r"(?<![\w$.])import\s+(?:type\s+)?(?P<what>[^'\"`;()]*?)\s*(?:from\s*)?(?P<q>['\"])(?P<from>[^'\"\n]*)(?P=q)")
_JSX = re.compile(rf"<(?P<name>[A-Z][\w$]*)(?=[\s/>.])")
_ANY_TAG = re.compile(r"(?<![\w$])<(?:[A-Za-z][\w.$]*(?=[\s/>])|>)")
_JSX_TEXT = re.compile(r">([^<>{}]*[一-鿿][^<>{}]*)<")
_NO_CALL = {"if", "for", "while", "switch", "catch", "return", "function", "typeof", "await", "else", "do", "in", "of", "case", "void", "delete", "throw", "yield", "instanceof", "with", "async"}
_OPEN = {")": "(", "]": "[", "}": "{"}


def lexed(src: str) -> tuple[str, list[tuple[int, int]], dict[int, int]]:
    """The code with everything else blanked, places and lines kept; the spans of strings and template parts; and where
    the string or regular expression that ends at a place begins."""
    out, strings, literals, stack, i, n = [], [], {}, [], 0, len(src)
    blank = lambda a, z: out.append(re.sub(r"[^\n]", " ", src[a:z]))

    def template(i: int) -> int:
        """From within a template on to its end or its next substitution."""
        a = i
        while i < n and src[i] != "`" and not src.startswith("${", i):
            i += 2 if src[i] == "\\" else 1
        strings.append((a, min(i, n)))
        blank(a, min(i, n))
        if i < n and src[i] == "$":
            out.append(" {")
            stack.append("$")
            return i + 2
        out.append(" " * (i < n))
        return i + 1

    while i < n:
        c = src[i]
        if m := _PLAIN.match(src, i):
            out.append(m[0])
            i = m.end()
        elif c == "`":
            out.append(" ")
            i = template(i + 1)
        elif c == "{":
            stack.append("{")
            out.append(c)
            i += 1
        elif c == "}":
            out.append(c)
            i = template(i + 1) if stack and stack.pop() == "$" else i + 1
        elif src.startswith(("//", "/*"), i):
            z = src.find("\n", i) if src[i + 1] == "/" else src.find("*/", i) + 2
            z = n if z < i + 2 else z
            blank(i, z)
            i = z
        elif c == "/" and (m := _REGEX.match(src, i)) and re.search(r"(?:^|[(,=:\[!&|?{};+\-*%~^]|=>|\b(?:return|typeof|case|in|of))\s*$", "".join(out[-2:])[-40:]):
            blank(i, m.end())
            literals[m.end()] = i
            i = m.end()
        elif c in "'\"" and (m := _QUOTED.match(src, i)):
            strings.append((i + 1, m.end() - 1))
            literals[m.end()] = i
            blank(i, m.end())
            i = m.end()
        else:
            out.append(c)
            i += 1
    code = "".join(out)
    return _TAG_TEXT.sub(lambda m: ">" + re.sub(r"[^\n]", " ", m[1]), code), strings, literals


def _pairs(code: str) -> dict[int, int]:
    """Each bracket's partner, both ways; unpaired ones are left out."""
    pair, open_ = {}, []
    for m in re.finditer(r"[()\[\]{}]", code):
        c = m[0]
        if c in "([{":
            open_.append(m.start())
        elif open_ and code[open_[-1]] == _OPEN[c]:
            pair[m.start()], pair[open_[-1]] = open_[-1], m.start()
            open_.pop()
    return pair


def _statement_end(code: str, pair: dict[int, int], at: int, comma: bool = True) -> int:
    """Where the expression from ``at`` on ends: before a comma or semicolon outside its brackets, or at a line's end after
    which it doesn't go on."""
    i = at
    while i < len(code):
        c = code[i]
        if c in "([{":
            i = pair.get(i, len(code))
        elif c in ")]};" or (comma and c == ","):
            return i
        elif c == "\n" and code[at:i].strip() and not re.search(r"[=(,.?:&|+\-*/<>]\s*$", code[at:i]) and not re.match(r"\s*[.?:&|+\-*/=,<]", code[i:]):
            return i
        i += 1
    return len(code)


def _callee(code: str, pair: dict[int, int], literals: dict[int, int], at: int) -> int | None:
    """Where the expression called by the bracket at ``at`` begins; null if the bracket calls nothing."""
    i = at
    while i not in literals:
        back = len(code[:i].rstrip()) if i and code[i - 1].isspace() else i
        if back and code[back - 1] == ">" and (m := re.search(r"(?<=[\w$])<[\w$\s,.|&\[\]<>]*>$", code[max(0, back - 80) : back])):
            back -= len(m[0])  # type arguments
        if code[max(0, back - 2) : back] == "?.":
            back -= 2
        part = back
        while part and code[part - 1] in ")]" and part - 1 in pair:
            part = pair[part - 1]
        while part and (code[part - 1].isalnum() or code[part - 1] in "_$#"):
            part -= 1
        if part == back:
            return None
        before = len(code[:part].rstrip()) if part and code[part - 1].isspace() else part
        if before and code[before - 1] == "." and code[max(0, before - 3) : before] != "...":
            i = before - 1
            i -= code[i - 1 : i] == "?"
            continue
        return part
    return literals[i] if i < at else None


def facts_of(path: str, src: str) -> Iterator[tuple]:
    """Rows of FACT_SCHEMA for one file."""
    code, strings, literals = lexed(src)
    pair = _pairs(code)
    breaks = [m.start() for m in re.finditer("\n", src)]
    line = lambda i: bisect_left(breaks, i) + 1
    first = lambda i: src[i:].split("\n", 1)[0].strip()[:200]
    scopes: list[tuple[int, int, str]] = []
    defined: set[int] = set()  # brackets of parameters

    def body(at: int, stop: int) -> int:
        """The end of the block that opens after parameters, or of the statement."""
        open_ = code.find("{", at, stop)
        return pair.get(open_, stop) if open_ >= 0 else stop

    def kind(at: int, end: int, plain: str) -> str:
        return "component" if _ANY_TAG.search(code, at, end) else plain

    def scope(start: int, end: int, name: str, nested: bool) -> None:
        outer = next((q for a, z, q in reversed(scopes) if a <= start <= z), None)
        scopes.append((start, end, f"{outer}.{name}" if nested and outer else f"{path}::{name}"))

    for m in _DECL.finditer(code):
        if m["fn"]:
            open_ = code.find("(", m.end())
            defined.add(open_)
            close = pair.get(open_, len(code))
            end = body(close, min(len(code), _statement_end(code, pair, close + 1, comma=False) + 1) if "{" not in code[close:] else len(code))
            yield "symbol", path, m["fname"], kind(close, end, "function"), line(m.start()), line(min(end, len(code) - 1)), bool(m["exp"]), first(m.start()), [src[open_ : close + 1][:150]], None
            scope(m.start(), end, m["fname"], False)
        elif m["cls"]:
            open_ = code.find("{", m.end())
            end = pair.get(open_, len(code) - 1)
            yield "symbol", path, m["cname"], "class", line(m.start()), line(end), bool(m["exp"]), first(m.start()), [""], None
            i = open_ + 1
            while 0 < i < end:  # members of the class, whatever lies in their brackets
                x = _METHOD.match(code, i)
                close = pair.get(x.end(), -1) if x else -1
                after = re.match(r"\s*(?::[^{;=]+)?\{", code[close + 1 :]) if close > 0 else None
                if x and after and x["name"] not in _NO_CALL:
                    defined.add(x.end())
                    stop = pair.get(close + after.end(), end)
                    yield "symbol", path, x["name"], "method", line(x.start("name")), line(stop), False, first(x.start("name")), [src[x.end() : close + 1][:150]], None
                    scopes.append((x.start(), stop, f"{path}::{m['cname']}.{x['name']}"))
                    i = stop + 1
                else:
                    i = pair.get(i, i) + 1 if code[i] in "([{" else re.compile(r"[\w$]+|.", re.S).match(code, i).end()
        else:
            at = m.end()
            while d := _DECLARATOR.match(code, at):
                end = _statement_end(code, pair, d.end())
                f, w = _FUNCTION.match(code, d.end()), _WRAPPER.match(code, d.end())
                wrapped = bool(w) and re.search(r"=>|\bfunction\b", code[w.end() : pair.get(w.end(), end)])
                open_ = code.find("(", d.end(), end)
                arrow = f and ("function" in f[0] or f[0].endswith("=>") or re.match(r"\s*(?::[^;=]+)?=>", code[pair.get(open_, end) + 1 :]))
                if arrow or wrapped:
                    start = m.start() if at == m.end() else d.start("name")
                    if not wrapped and not f[0].endswith("=>"):
                        defined.add(open_)
                    params = src[open_ : pair.get(open_, open_) + 1][:150] if arrow and not f[0].endswith("=>") else ""
                    yield "symbol", path, d["name"], kind(d.end(), end, "arrow_const"), line(start), line(min(max(end - 1, 0), len(code) - 1)), bool(m["exp"]), first(start), [params], None
                    scope(start, end, d["name"], True)
                if end < len(code) and code[end] == ",":
                    at = end + 1
                else:
                    break
    for m in _IMPORT.finditer(src):
        if code[m.start() : m.start() + 6] != "import":
            continue
        inner = re.search(r"\{([^}]*)\}", m["what"])
        names = [p.split(" as ")[-1].strip().removeprefix("type ") for p in (inner[1].split(",") if inner else []) if p.strip()]
        names += [p.split(" as ")[-1].strip() for p in re.sub(r"\{[^}]*\}", "", m["what"]).split(",") if p.strip()]
        yield "import", path, m["from"], None, line(m.start()), None, None, None, names, None
    for m in re.finditer(r"\(", code):
        at = m.start()
        start = None if at in defined else _callee(code, pair, literals, at)
        if start is None:
            continue
        callee = re.sub(r"\s+", "", src[start:at]).replace("?.", ".").removesuffix(".")
        callee = re.sub(r"(?<=[\w$])<[^()]*>$", "", callee)
        close = pair.get(at, at)
        word = re.search(r"([\w$]+)\s*\*?\s*$", code[:start])
        if callee in _NO_CALL or len(callee) > 80 or (word and word[1] in ("new", "function")):
            continue
        if re.match(r"\s*(?::[^{;=()]+)?\{", code[close + 1 :]) and re.fullmatch(rf"#?{_NAME}", callee):  # a method of an object
            continue
        inside = [(z - a, q) for a, z, q in scopes if a <= at <= z]
        yield "call", path, callee, callee.rsplit(".", 1)[-1], line(start), None, None, None, None, min(inside)[1] if inside else f"{path}::<module>"
    for m in _JSX.finditer(code):
        if m.start() == 0 or not (code[m.start() - 1].isalnum() or code[m.start() - 1] in "_$"):  # not type arguments
            yield "jsx", path, m["name"], None, line(m.start()), None, None, None, None, None
    for a, z in strings:
        if z - a <= 200 and _CJK.search(src, a, z):
            yield "ui", path, src[a:z][:150], "string", line(a), None, None, None, None, None
    for m in _JSX_TEXT.finditer(src):
        t = m[1].strip()
        if 2 <= len(t) <= 150 and code[m.start()] == ">":
            yield "ui", path, t, "jsx_text", line(m.start(1)), None, None, None, None, None


def facts(files: DataFrame) -> DataFrame:
    """One tagged row for each fact of the code files (path, content)."""

    def scan(batches):
        import pandas as pd

        names = [c.split()[0] for c in FACT_SCHEMA.split(", ")]
        for pdf in batches:
            out = pd.DataFrame([r for p, c in zip(pdf["path"], pdf["content"], strict=True) for r in facts_of(p, c or "")], columns=names)
            for c in ("line_start", "line_end"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(scan, FACT_SCHEMA)


def fact_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """symbols, imports, calls, jsx_refs, ui_strings as the operators take them."""
    s = rows.where("fact = 'symbol'")
    return {
        "symbols": s.select(F.concat_ws("::", "file", "name").alias("qualified"), "name", "kind", "file", "line_start", "line_end", "exported", F.col("names")[0].alias("params"), F.col("detail").alias("snippet"), F.struct("file", "line_start", "name").alias("ord")),
        "imports": rows.where("fact = 'import'").select(F.col("file").alias("importer"), F.col("name").alias("specifier"), "names", F.col("line_start").alias("line")),
        "calls": rows.where("fact = 'call'").select("caller", F.col("file").alias("caller_file"), F.col("name").alias("callee"), F.col("kind").alias("callee_short"), "file", F.col("line_start").alias("line")),
        "jsx_refs": rows.where("fact = 'jsx'").select("file", F.col("line_start").alias("line"), F.col("name").alias("component")),
        "ui_strings": rows.where("fact = 'ui'").select("file", F.col("line_start").alias("line"), F.col("name").alias("text"), (F.col("kind") == "jsx_text").alias("in_jsx_text")),
    }
