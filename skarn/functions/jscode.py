"""Units of JavaScript and TypeScript source, from a tokenizer and a light parser of our own.

The parser knows blocks, parameter lists, arrows and the statements that count; everything else is a run of tokens. It
reads template strings and regular expressions as single tokens; JSX text is read as tokens too.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)"""
    r"""|(?P<num>\d[\w.]*)|(?P<op>=>|\?\?=?|\?\.|&&=?|\|\|=?|===?|!==?|\.\.\.|[-+*/%<>=!&|^~?:;,.(){}\[\]@#`\\])|(?P<other>.)""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "await", "yield"}
_KEYWORDS = {"if", "for", "while", "do", "switch", "catch", "try", "else", "return", "function", "class", "new", "with", "finally", "case", "default", "typeof", "delete", "throw", "in", "of", "await", "yield", "var", "let", "const", "import", "export"}
#: Statements that add a path, and those that nest.
_PATHS, _NESTS = {"if", "for", "while", "do", "case", "catch"}, {"if", "for", "while", "do", "try", "catch", "switch"}


def tokens(source: str) -> list[tuple[str, str, int]]:
    """``(kind, text, line)``; a template string is one token."""
    out: list[tuple[str, str, int]] = []
    at, line = 0, 1
    while at < len(source):
        c = source[at]
        if c == "`":
            end, depth = at + 1, 0
            while end < len(source) and (source[end] != "`" or depth):
                if source[end] == "\\":
                    end += 1
                elif source.startswith("${", end):
                    depth += 1
                    end += 1
                elif source[end] == "}" and depth:
                    depth -= 1
                end += 1
            text, kind = source[at : end + 1], "str"
        else:
            last = out[-1] if out else ("op", "", 0)
            m = None
            if c == "/" and (last[0] == "op" and last[1] not in (")", "]", "}") or last[1] in _BEFORE_REGEX):
                m = _REGEX.match(source, at)
            if m:
                text, kind = m[0], "str"
            else:
                m = _TOKEN.match(source, at)
                text, kind = m[0], m.lastgroup
        if kind != "skip":
            out.append((kind, text, line))
        line += text.count("\n")
        at += len(text)
    return out


class _Unit:
    def __init__(self, name: str, line: int, typed: bool):
        self.name, self.line, self.typed = name, line, typed
        self.end, self.paths, self.depth = line, 1, 0

    def row(self) -> dict:
        loc = self.end - self.line + 1
        acl = (self.depth * 2.0) + (self.paths * 1.5) + (loc / 50.0)
        return {"name": self.name, "lineno": self.line, "complexity": float(self.paths), "loc": loc, "acl": acl, "is_typed": self.typed, "nesting_depth": self.depth}


class Reader:
    """One pass over the tokens with a recursive reader of statements and expressions."""

    def __init__(self, source: str):
        self.t = tokens(source)
        self.pair = self._pairs()
        self.units: list[_Unit] = []

    def _pairs(self) -> dict[int, int]:
        """Matching brackets, by token."""
        out, open_ = {}, []
        for i, (kind, text, _) in enumerate(self.t):
            if kind == "op" and text in "([{":
                open_.append(i)
            elif kind == "op" and text in ")]}" and open_:
                j = open_.pop()
                out[i], out[j] = j, i
        return out

    def text(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) and self.t[i][0] != "str" else ""

    def read(self) -> list[dict]:
        self.statements(0, len(self.t), None, 0)
        self.units.sort(key=lambda u: u.at)
        return [u.row() for u in self.units]

    def function(self, start: int, params: int, body: int, name: str, after: int | None = None) -> int:
        """Read a function whose parameters and body begin at these tokens; the token after it."""
        close = self.pair.get(params, params)
        typed = after is not None or any(self.text(i) == ":" for i in self.top(params + 1, close))
        unit = _Unit(name, self.t[start][2], typed)
        unit.at = start
        self.units.append(unit)
        self.statements(params + 1, close, unit, 0)
        if self.text(body) == "{":
            end = self.pair.get(body, len(self.t) - 1)
            self.statements(body + 1, end, unit, 0)
            unit.end = self.t[min(end, len(self.t) - 1)][2]
            return end + 1
        end = self.expression_end(body)
        self.statements(body, end, unit, 0)
        unit.end = self.t[end - 1][2] + self.t[end - 1][1].count("\n") if end > body else unit.line
        return end

    def top(self, i: int, end: int):
        """Tokens between, leaving out what is in braces after ``=``."""
        while i < end:
            if self.text(i) == "{" and self.text(i - 1) not in (":", ""):
                i = self.pair.get(i, i)
            yield i
            i += 1

    def expression_end(self, i: int) -> int:
        """Where an arrow's expression body ends."""
        while i < len(self.t):
            x = self.text(i)
            if x in ("(", "[", "{"):
                i = self.pair.get(i, len(self.t)) + 1
                continue
            if x in (",", ";", ")", "]", "}"):
                return i
            nxt = i + 1
            if nxt < len(self.t) and self.t[nxt][2] > self.t[i][2] and self.t[i][0] in ("name", "num", "str") and self.t[nxt][0] in ("name", "num"):
                return nxt  # a statement of the next line
            i += 1
        return len(self.t)

    def return_type(self, close: int) -> tuple[int, int | None]:
        """After a parameter list: the token that follows, and where a return type stands if there is one."""
        i = close + 1
        if self.text(i) != ":":
            return i, None
        at = i
        i += 1
        while i < len(self.t):
            x = self.text(i)
            if x == "=>" or x == ";":
                break
            if x == "{" and i > at + 1 and self.text(i - 1) not in ("|", "&", "<", ","):
                break
            i = self.pair.get(i, i) + 1 if x in ("(", "[", "{") and self.pair.get(i, -1) > i else i + 1
        return i, at

    def arrow(self, i: int) -> tuple[int, int, int | None] | None:
        """``(parameters, body, return type)`` if an arrow function begins at token ``i``."""
        j = i + 1 if self.text(i) == "async" and (self.text(i + 1) == "(" or self.text(i + 2) == "=>") else i
        if self.text(j) == "(" and j in self.pair:
            k, typed = self.return_type(self.pair[j])
            if self.text(k) == "=>":
                return j, k + 1, typed
        elif j < len(self.t) and self.t[j][0] == "name" and self.text(j + 1) == "=>":
            return j, j + 2, None
        return None

    def method(self, i: int) -> tuple[int, int, int | None] | None:
        """``(parameters, body, return type)`` if ``name (...) {`` begins at token ``i``."""
        if i < len(self.t) and self.t[i][0] in ("name", "str", "num") and self.text(i) not in _KEYWORDS and self.text(i - 1) not in (".", "new", "?."):
            j = i + 1
            if self.text(j) == "<":  # type parameters; a comparison has no ">(" of its own
                while j < len(self.t) and self.text(j) not in ("(", ")", ";", "{", "}"):
                    j += 1
                if self.text(j - 1) != ">":
                    return None
            if self.text(j) == "(" and j in self.pair:
                k, typed = self.return_type(self.pair[j])
                if self.text(k) == "{" and k in self.pair:
                    return j, k, typed
        return None

    def statements(self, i: int, end: int, unit: _Unit | None, depth: int) -> None:
        while i < end:
            i = self.one(i, end, unit, depth)

    def nested(self, i: int, end: int, unit: _Unit | None, depth: int) -> int:
        """The body of a control statement: a block or one statement."""
        if self.text(i) == "{" and i in self.pair:
            self.statements(i + 1, self.pair[i], unit, depth)
            return self.pair[i] + 1
        if self.text(i) in _NESTS:
            return self.one(i, end, unit, depth)
        while i < end and self.text(i) != ";":
            line = self.t[i][2]
            i = self.one(i, end, unit, depth)
            if i < end and self.t[i][2] > line and self.text(i) not in (".", "&&", "||", "?", ":", "+", ")", "]", "}"):
                return i
        return min(i + 1, end)

    def one(self, i: int, end: int, unit: _Unit | None, depth: int) -> int:
        """Read one token's worth of syntax at ``i``."""
        x = self.text(i)
        property_ = self.text(i - 1) in (".", "?.") or self.text(i + 1) == ":" and x not in ("case", "default")
        if x == "function" and not property_:
            j = i + 1
            if self.text(j) == "*":
                j += 1
            named = j < end and self.t[j][0] == "name"
            declared = named and self.text(i - 1) in ("", ";", "{", "}", "async", "export", "default")
            name = self.text(j) if declared else "anonymous"
            j += named
            while j < end and self.text(j) != "(":
                j += 1
            k, typed = self.return_type(self.pair.get(j, j))
            return self.function(i, j, k, name, typed)
        if arrow := self.arrow(i):
            j, body, typed = arrow
            if self.text(j) != "(":  # one bare parameter
                unit_ = _Unit("anonymous", self.t[i][2], False)
                unit_.at = i
                self.units.append(unit_)
                stop = self.pair.get(body, body) + 1 if self.text(body) == "{" else self.expression_end(body)
                inner = body + (self.text(body) == "{")
                self.statements(inner, stop - (self.text(body) == "{"), unit_, 0)
                unit_.end = self.t[min(stop, len(self.t)) - 1][2]
                return stop
            return self.function(i, j, body, "anonymous", typed)
        if not property_ and x in _NESTS | {"case"}:
            if unit is not None:
                unit.paths += x in _PATHS
                if x in _NESTS:
                    unit.depth = max(unit.depth, depth + 1)
            if x == "case":
                return i + 1
            j, inner = i + 1, depth + 1
            if self.text(j) == "await":
                j += 1
            if self.text(j) == "(" and j in self.pair:
                self.statements(j + 1, self.pair[j], unit, inner)
                j = self.pair[j] + 1
            j = self.nested(j, end, unit, inner)
            if x == "do" and self.text(j) == "while":
                j += 1
                if j in self.pair:
                    self.statements(j + 1, self.pair[j], unit, inner)
                    j = self.pair[j] + 1
            elif x == "if" and self.text(j) == "else":
                j = self.nested(j + 1, end, unit, inner)
            elif x == "try":
                # catch and finally belong to the try statement, so a catch nests one deeper
                while self.text(j) in ("catch", "finally"):
                    if self.text(j) == "catch":
                        j = self.one(j, end, unit, inner)
                    else:
                        j = self.nested(j + 1, end, unit, inner)
            return j
        if x in ("&&", "||") and unit is not None:
            unit.paths += 1
            return i + 1
        if (m := self.method(i)) and not property_:
            j, k, typed = m
            return self.function(i, j, k, self.t[i][1], typed)
        return i + 1


def functions(source: str | None) -> list[dict]:
    return Reader(source).read() if source else []


def facts(files: DataFrame, key: str = "rel_path", content: str = "content") -> DataFrame:
    """One row a file: ``key, units``."""
    unit = "array<struct<name:string,lineno:int,complexity:double,loc:int,acl:double,is_typed:boolean,nesting_depth:int>>"

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "units": [functions(s if isinstance(s, str) else None) for s in pdf["content"]]})

    return files.select(F.col(key), F.col(content).alias("content")).mapInPandas(run, f"{key} string, units {unit}")
