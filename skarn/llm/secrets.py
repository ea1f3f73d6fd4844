"""Secret scans with assignment-aware lexing (operator 4).

Base patterns find assignments, access keys and hexadecimal runs. The method then reads source and
configuration syntax: tokens are lexed into name-literal pairs, names that are assigned other names are followed
to their literals, and each literal is scored by the names it ends up under and by its own look. Literals that score
enough are added as spans of kind ``literal``. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base patterns, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # greedy runs, so a minimum within the pattern drops the same matches
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_MIN = 12
KINDS = ("assign", "access", "hex", "literal")

#: Words of names and how far each makes its literal a secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "secrets": 1.0,
    "token": 0.9, "credential": 0.9, "credentials": 0.9, "apikey": 1.0, "bearer": 0.8, "auth": 0.5, "private": 0.5,
    "key": 0.55, "api": 0.5, "access": 0.4, "signature": 0.4, "salt": 0.5, "conn": 0.3, "dsn": 0.5, "webhook": 0.4,
}
PLACEHOLDER = re.compile(r"(?i)^(x+|\*+|\.+|none|null|true|false|changeme|example.*|your.*|test|todo|dummy|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%)$")
#: Score from which a literal counts.
LITERAL_SCORE = 0.6
LITERAL_MIN = 8
#: Values longer than this that overlap are scored together, so that keys within values cost no square.
LONG = 1024

_TOKEN = re.compile(
    r"""(?P<str>"(?:[^"\\\n]|\\[^\n])*"|'(?:[^'\\\n]|\\[^\n])*'|`[^`\n]*`)"""
    r"""|(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)|(?P<op>=>|:=|==|!=|<=|>=|[=:])|(?P<plus>\+)|(?P<bare>[A-Za-z0-9/_.=\-]{8,})|(?P<other>\\["'`]|\S)"""
)
_SIGNS = ("=", ":", ":=", "=>")
_QUOTES = ('"', "'")
_PREFIXES = frozenset(("b", "r", "u", "f", "br", "rb", "fr", "rf"))
#: Before ``name: other = value`` these make the colon the head of a statement.
_HEADS = frozenset(("if", "elif", "while", "for", "in", "not", "and", "or", "is", "with", "as", "except", "case"))
_LINE = re.compile(r"\S(?:[^\n]*\S)?")
_BLANK = re.compile(r"[ \t]*")
_EOL = re.compile(r"\r?(?:\n|\Z)")
_REST = re.compile(r"[ \t]*\r?\n")
_BLOCK = re.compile(r"[ \t]*[|>][-+0-9]{0,2}[ \t]*(?:\x20#[^\n]*)?\r?\n")
_ITEM = re.compile(r"""[ \t]*(-[ \t]+)?(?!["'(\[{#&*])(\S*[^\s:,])[ \t\r]*(?=\n|\Z|\x20\#)""")
_RUN = re.compile(r"\S+")
_NEXT_KEY = re.compile(r"""[,;&|]["']?[A-Za-z_][A-Za-z0-9_.\-]*["']?[=:]|</?[A-Za-z][A-Za-z0-9]*(?:/?>|\Z)""")
_CALL = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::|\?\.)[A-Za-z_$][\w$]*)*[(\[]")
#: Paths of names and references; anchors and operators before a name, and the name.
_CODE = re.compile(r"[A-Za-z_$][\w$]*(?:(?:\.|->|::|\?\.)[A-Za-z_$][\w$]*)+|\$\w+|[@%]\w+%?")
_SIGNED = re.compile(r"[&*@!~$-]+[A-Za-z_]")
_SIGNED_NAME = re.compile(r"[A-Za-z_.\->:]*")
_OPENS = {")": "(", "]": "[", "}": "{", ">": "<"}
_BRACKETS = re.compile(r"""["'`()\[\]{}<>]""")
_TRIMMED = frozenset(",;\"'`)]}>")
_LEAD = re.compile(r"[ \t]*(?:-[ \t]*)?")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How sensitive a target name is: one minus the product of what its words leave open."""
    open_ = 1.0
    for w in _WORD.findall(name):
        open_ *= 1.0 - SENSITIVE.get(w.lower(), 0.0)
    return 1.0 - open_


def literal_score(value: str) -> float:
    """0 for placeholders and short or wordy values, up to 1 for long random ones."""
    if len(value) < LITERAL_MIN or PLACEHOLDER.match(value) or any(c.isspace() for c in value):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = any(c.isdigit() for c in value) + any(c.isalpha() for c in value) + any(not c.isalnum() for c in value)
    return min(1.0, bits / 4.0) * (0.6 + 0.2 * min(2, mixed - 1)) if mixed else 0.0


def literal_scores(text: str, spans: list[tuple[int, int]]) -> list[float]:
    """:func:`literal_score` of each span, in order of their starts; of long ones that overlap the characters are counted once."""
    out, counts, lo, hi, reach = [], Counter(), 0, 0, 0
    for k, (i, j) in enumerate(spans):
        long_ = j - i > LONG
        if not long_ or i >= reach and (k + 1 == len(spans) or spans[k + 1][0] >= j):
            out.append(literal_score(text[i:j]))
            reach = max(reach, j) if long_ else reach
            continue
        reach = max(reach, j)
        if i >= hi:
            counts, lo, hi = Counter(), i, i
        counts.subtract(text[lo:i])
        if j > hi:
            counts.update(text[hi:j])
        else:
            counts.subtract(text[j:hi])
        lo, hi = i, j
        counts = +counts
        plain = PLACEHOLDER.match(text[i : i + 8] + text[j - 8 : j])  # what lies between decides for runs of one sign alone
        if any(map(str.isspace, counts)) or plain and (plain[1][0] not in "xX*." or len(set("".join(counts).lower())) == 1):
            out.append(0.0)
            continue
        n = j - i
        bits = -sum(c / n * math.log2(c / n) for c in counts.values())
        mixed = any(map(str.isdigit, counts)) + any(map(str.isalpha, counts)) + any(not c.isalnum() for c in counts)
        out.append(min(1.0, bits / 4.0) * (0.6 + 0.2 * min(2, mixed - 1)))
    return out


def _line_parts(text: str, start: int, end: int) -> list[tuple]:
    """Each line of a stretch of text as a literal of its own, without the white space around it."""
    return [("lit", m.start(), m.end()) for m in _LINE.finditer(text, start, end)]


def _indent(text: str, at: int) -> int:
    return _BLANK.match(text, at).end() - at


def _yaml_value(text: str, start: int, key: int, pos: int) -> list[tuple]:
    """A YAML value that begins below its key, the first of its line: a block, an indented plain word or a list of words."""
    block = _BLOCK.match(text, pos)
    bare_end = block or _REST.match(text, pos)
    if not bare_end:
        return []
    col = key - start
    at, parts = bare_end.end(), []
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        if text[at:stop].strip():
            indent = _indent(text, at)
            if block:
                if indent <= col:
                    break
                parts += _line_parts(text, at, stop)
            else:
                m = _ITEM.match(text, at)
                if not m or indent < col or (indent == col and not m[1]):
                    break
                parts.append(("lit", m.start(2), m.end(2)))
                if not m[1]:
                    break
        at = stop + 1
    return parts


def _typed(text: str, toks: list, k: int) -> int:
    """Where ``= value`` follows a type that begins at token ``k``: the index of the sign, else -1."""
    depth, last, life = 0, "", False
    for n in range(k, len(toks)):
        kind, i, j = toks[n]
        c = text[i]
        if kind == "op":
            if text[i:j] != "=" or n == k or depth or n + 1 >= len(toks) and text[j : j + 2].strip():
                return -1
            # Without white space an unquoted rest is one value, such as abc=def.
            quoted = n + 1 < len(toks) and (toks[n + 1][0] == "str" or text[toks[n + 1][1]] in "([{")
            return n if quoted or (text[i - 1].isspace() and text[j : j + 1].isspace()) else -1
        if kind in ("name", "bare") and last in ("name", "bare") and not life:
            return -1
        if kind == "str" and n > k and not depth:
            return -1
        if kind == "plus" or kind == "other" and c not in "[]<>()|&?*!',":
            return -1
        depth += (c in "[<(") - (c in "]>)") if kind == "other" else 0
        if depth < 0 or (c == "," and kind == "other" and not depth):
            return -1
        life = kind == "name" and n > k and text[i - 1] == "'"  # a lifetime
        last = kind
    return -1


class _Runs:
    """Ends of the unquoted values of a text.

    Keys within a value have values of their own, up to the same white space. What holds for the whole run of
    characters (its end, its brackets, the next key, where closing signs begin) is found once for all of them.
    """

    def __init__(self, text: str):
        self.text, self.start, self.stop = text, 0, 0

    def _enter(self, i: int) -> None:
        self.start, self.stop = i, _RUN.match(self.text, i).end()
        self.ended = self.stop >= len(self.text) or bool(_REST.match(self.text, self.stop))
        self.next = self.named = self.name_stop = -1
        self.tails: dict[int, int] = {}
        self.at: dict[str, list[int]] = {c: [] for c in "\"'`()[]{}<>"}
        self.close: dict[int, int] = {}
        opened: dict[str, list[int]] = {"(": [], "[": []}
        for m in _BRACKETS.finditer(self.text, i, self.stop):
            c = m[0]
            self.at[c].append(m.start())
            if c in "([":
                opened[c].append(m.start())
            elif c in ")]" and opened[_OPENS[c]]:
                self.close[opened[_OPENS[c]].pop()] = m.start()

    def _cut(self, i: int) -> int:
        """Where a tag or a separator before the next key stands, behind ``i``."""
        if self.next <= i:
            m = _NEXT_KEY.search(self.text, i + 1, self.stop)
            self.next = m.start() if m else self.stop
            while m and self.next > i + 1 and self.text[self.next] in ",;&|" and self.text[self.next - 1] in ",;&|":
                self.next -= 1
        return self.next

    def _trimmed(self, i: int, end: int) -> int:
        """The end without commas, semicolons, odd quotes and closing signs that the value doesn't open."""
        if end not in self.tails:
            tail = end
            while tail > self.start and self.text[tail - 1] in _TRIMMED:
                tail -= 1
            self.tails[end] = tail
        last = max(self.tails[end], i)
        if last == end:
            return end
        for c in "\"'`)]}>":
            at = self.at[c]
            stop = bisect_left(at, end)
            n = stop - bisect_left(at, i)
            if c in _OPENS:
                opens = self.at[_OPENS[c]]
                kept = min(n, bisect_left(opens, end) - bisect_left(opens, i))
            else:
                kept = n - n % 2
            if kept:
                last = max(last, at[stop - n + kept - 1] + 1)
        return last

    def _code(self, i: int, end: int) -> bool:
        """Whether names, references or commands stand there."""
        if self.text.startswith("$(", i) and end > i + 1 or _CODE.fullmatch(self.text, i, end):
            return True
        if not (m := _SIGNED.match(self.text, i, end)):
            return False
        if not self.named <= m.end() <= self.name_stop:
            self.named, self.name_stop = m.end(), _SIGNED_NAME.match(self.text, m.end(), self.stop).end()
        return self.name_stop >= end

    def end(self, i: int) -> int:
        """Where the unquoted value at ``i`` ends if it is more than the lexer's token, else -1 (names and code).

        It goes up to white space, or to a tag or a separator before the next key, without closing signs that it doesn't open.
        """
        text = self.text
        if not self.start <= i < self.stop:
            self._enter(i)
        stop = self._cut(i)
        if code := _CALL.match(text, i, stop):
            # A call or subscript: its bracket is closed before anything but a letter or sign, or goes on behind the run.
            n = self.close.get(code.end() - 1, stop)
            if n < stop:
                if n + 1 == stop or not (text[n + 1].isalnum() or text[n + 1] in "_!@#$%^&~"):
                    return -1
            elif text[stop - 1] in "([{," or not self.ended:
                return -1
        end = self._trimmed(i, stop)
        return -1 if end == i or self._code(i, end) else end


def _value(text: str, pos: int, runs: _Runs) -> tuple[list[tuple], int]:
    """The parts of the value after a sign, and where it ends.

    Within brackets, after a sign or a plus, and behind a backslash it goes on over line ends; the next name that
    has a sign of its own ends it, so no stretch is read for two names.
    """
    parts: list[tuple] = []
    depth, wanted, below = 0, True, False  # open brackets, whether an operand must follow, whether on a later line
    end = pos
    while m := _TOKEN.search(text, end):
        kind, i, j = m.lastgroup, m.start(), m.end()
        c = text[i]
        if text.find("\n", end, i) >= 0 and not depth:
            if not wanted:
                break
            below = True
        if c == "\\" and (k := _EOL.match(text, j)):
            end = k.end()  # the next line belongs to this one
            continue
        if kind == "name" and text[j : j + 1] in _QUOTES and text[i:j].lower() in _PREFIXES:
            m = _TOKEN.match(text, j)
            kind, i, j = m.lastgroup, m.start(), m.end()
            c = text[i]
        quote = text[i : i + 3] if text.startswith(('"""', "'''"), i) else "`" if c == "`" else ""
        if quote:
            close = text.find(quote, i + len(quote))
            if close < 0:
                break
            parts += _line_parts(text, i + len(quote), close)
            end, wanted = close + len(quote), False
            continue
        if kind == "str":
            if (depth or below) and (n := _TOKEN.search(text, j)) and n.lastgroup == "op" and n[0] in _SIGNS:
                break
            parts.append(("lit", i + 1, j - 1))
            wanted = False
        elif kind in ("name", "bare"):
            if depth:
                n = _TOKEN.search(text, j)
                if n and (n[0] in _SIGNS or n[0] == "("):
                    break
                parts.append(("name", text[i:j]))
            elif below or not wanted:
                break
            else:
                while (n := _TOKEN.match(text, j)) and n.lastgroup in ("name", "bare", "plus"):
                    j = n.end()  # a bare value that the lexer cut
                whole = max(j, runs.end(i)) if not parts else j
                parts.append(("ref", i, whole))
            wanted = False
        elif kind == "plus":
            if wanted and not depth:
                if not (parts or below) and (whole := runs.end(i)) > 0:
                    parts.append(("lit", i, whole))
                    end = j
                break
            wanted, below = True, False
        elif kind == "other" and c in "([{" and (wanted or depth):
            depth += 1
        elif kind == "other" and c in ")]}" and depth:
            depth -= 1
            wanted = False
        elif kind == "other" and depth and c == ",":
            wanted = True
        elif depth and (c == "#" or text.startswith("//", i)):
            stop = text.find("\n", i)
            j = len(text) if stop < 0 else stop
        elif kind == "other" and wanted and not (parts or depth or below) and (whole := runs.end(i)) > 0:
            parts.append(("lit", i, whole))
            wanted = False
        else:
            break
        end = j  # keys within an unquoted value are read as well
    return parts, end


def lex_pairs(text: str) -> list[tuple[str, list]]:
    """``(name, parts)`` of each assignment; a part is ``("lit", start, end)``, ``("ref", start, end)`` or,
    for names within brackets, ``("name", name)``. Names are read line by line, values as far as they go."""
    pairs = []
    runs = _Runs(text)
    at = 0
    while at < len(text):  # only lines with an assignment sign are lexed
        nxt = min((i for i in (text.find("=", at), text.find(":", at)) if i >= 0), default=-1)
        if nxt < 0:
            break
        start = text.rfind("\n", at, nxt) + 1 or at
        stop = text.find("\n", nxt)
        stop = len(text) if stop < 0 else stop
        toks = [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text, start, stop)]
        k = 0
        lead = _LEAD.match(text, start).end()
        while k < len(toks) - 1:
            kind, i, j = toks[k]
            sign = k + 1
            if kind == "name" and text[toks[sign][1]] in "?!" and toks[sign][1] == j and sign + 1 < len(toks):
                sign += 1  # optional members
            if kind not in ("name", "str") or toks[sign][0] != "op" or text[toks[sign][1] : toks[sign][2]] not in _SIGNS:
                k += 1
                continue
            name = text[i + 1 : j - 1] if kind == "str" else text[i:j]
            pos = toks[sign][2]
            colon = text[pos - 1] == ":"
            typed = _typed(text, toks, sign + 1) if colon else -1
            parts = _yaml_value(text, start, i, pos) if colon and i == lead else []
            if parts:
                end = pos
            elif typed > 0 and k and text[toks[k - 1][1] : toks[k - 1][2]] in _HEADS:
                end = pos
            elif typed > 0:
                parts, end = _value(text, toks[typed][2], runs)
                inner = toks[typed - 1]
                if name_score(text[inner[1] : inner[2]]) >= 0.3:
                    end = inner[1]  # the last name before the sign is a target as well
            else:
                parts, end = _value(text, pos, runs)
            k = sign + 1
            while k < len(toks) and toks[k][1] < end:
                k += 1
            if parts:
                pairs.append((name, parts))
        at = stop + 1
    return pairs


def literal_spans(text: str) -> list[tuple[int, int, float]]:
    """Literals under sensitive names, after constants are propagated: ``(start, end, score)``."""
    pairs = lex_pairs(text)
    if not pairs:
        return []
    value = dict(pairs)  # the last assignment of a name counts for references
    sizes = set(map(len, value))  # only what is as long as a name is looked up
    best: dict[tuple[int, int], float] = {}
    done: set[str] = set()
    scored = sorted(((name_score(name), parts) for name, parts in pairs), key=lambda x: -x[0])
    # The most sensitive names first: what they have reached can't score more from others, so each name is followed once.
    for target, parts in scored:
        if target < 0.3:
            break
        todo = list(parts)
        while todo:
            part = todo.pop()
            if part[0] != "lit":
                name = part[1] if part[0] == "name" else text[part[1] : part[2]] if part[2] - part[1] in sizes else None
                if name in value:
                    if name not in done:
                        done.add(name)
                        todo += value[name]
                    continue
                if part[0] == "name":
                    continue
            best.setdefault(part[1:], target)
    spans = sorted(best)
    scores = [best[x] * y for x, y in zip(spans, literal_scores(text, spans))]
    return [(i, j, s) for (i, j), s in zip(spans, scores) if s >= LITERAL_SCORE]


def find_spans(text: str | None) -> list[tuple[int, int, int, float]]:
    """``(start, kind number, end, score)`` of all spans, by start, then kind."""
    if not text:
        return []
    out = [(m.start(), 2, m.end(), 1.0) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), 1.0) for m in ACCESS.finditer(text)]
    signed = "=" in text or ":" in text
    if signed:
        low = text.encode("utf-8", "surrogatepass").lower()
        if any(w in low for w in ASSIGN_WORDS):
            out += [(m.start(), 0, m.end(), 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
        out += [(i, 3, j, s) for i, j, s in literal_spans(text)]
    return sorted(out)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<kind, start, end, score>>`` for every whole text; null and empty texts have none.

    Time and memory grow in proportion to a text's length; one text is read in one task. Repeated rows give equal rows.
    """

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            got = [[{"kind": KINDS[k], "start": i, "end": j, "score": s} for i, k, j, s in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], ["doc_id", "spans"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """All columns of ``docs``, with each secret (overlapping spans as one) replaced by ``mark``; null stays null."""
    at = docs.columns.index(text_col)

    def clean(text: str | None) -> str | None:
        out, end = [], 0
        for i, _, j, _ in find_spans(text):
            if i >= end:
                out += [text[end:i], mark]
            end = max(end, j)
        return text if not out else "".join(out) + text[end:]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield b.set_column(at, b.schema.field(at), pa.array(map(clean, b.column(at).to_pylist()), b.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def digest(spans: DataFrame) -> DataFrame:
    """Counts and digests of the rows of :func:`scan`."""
    base = F.filter("spans", lambda s: s["kind"] != "literal")
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans.select(
        "doc_id",
        n("assign").alias("n_assign"),
        n("access").alias("n_access"),
        n("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        n("literal").alias("n_literal"),
    )
