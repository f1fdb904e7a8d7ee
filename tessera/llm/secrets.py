"""Secret scans by assignment-aware lexing.

Three base patterns are found in any text.  The lexer adds to them: it reads
source and configuration syntax (strings of one line or several, calls, indexed
names, annotations, JSON, YAML, INI, environment files; comments as well, for
secrets leak there too) into name-literal pairs, carries the literals of constants
over to names that they are assigned to, and scores each literal by the names
that it reaches.  Its work is linear in the length of a text.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import slices, texts_of

#: Base kinds in their order; ``pair`` is the lexer's.
KINDS = ("assign", "access", "hex", "pair")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: What a text must hold for any of them; a text without it is not looked at again.
MAY_HOLD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"

#: Parts of names and how sensitive each is, fixed values.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9, "apikey": 1.0, "key": 0.5, "auth": 0.6, "credential": 0.9, "credentials": 0.9, "private": 0.5, "api": 0.4, "access": 0.4, "salt": 0.5}
#: White space and continued lines, as the lexer skips them.
_GAP = r"(?:[\x20\t\r]|\\\r?\n)*"
#: What a text must hold for a pair: a listed word in a name, a quoted one or that of an index, before an assignment.
MAY_PAIR = rf"(?i)({'|'.join(SENSITIVE)})[A-Za-z0-9_.\-]*[\"'`]*{_GAP}\]*{_GAP}(:=|=>|[:=])"
#: What a name with any of them counts at least, so that a random literal reaches the threshold under the weakest.
ALONE = 0.7
THRESHOLD = 0.9
LEAST_CHARS = 8

#: No token is tried again from its middle and none gives back what it has taken, so long words and lines cost one pass.
_TOKEN = re.compile(
    r"""(?P<space>[\x20\t\r]++|\\\r?\n)
    |(?P<string>(?P<q>\"{3}|'{3})(?s:(?:\\.|(?!(?P=q)).)*+)(?P=q)
       |"(?:\\.|[^"\\\n])*+"|(?:(?<![A-Za-z0-9])|(?<=\b[rbfuRBFU]))'(?:\\.|[^'\\\n])*+'|`(?:\\.|[^`\\\n])*+`)
    |(?P<name>[A-Za-z_$][A-Za-z0-9_.\-]*+)
    |(?P<set>:=|=>|[:=](?!=))
    |(?P<line>\n)
    |(?P<open>[(\[{])|(?P<close>[)\]}])
    |(?P<word>[^\s"'`,;(){}\[\]<>=:+|]++)
    |(?P<sign>[=:!<>]?=|.)""",
    re.X,
)
_BARE = re.compile(r"""[^\s"'`,;(){}\[\]<>]++""")
_KEY = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*+")
_INDENT = re.compile(r"\x20*+")
_HOLE = re.compile(r"\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
_PLACEHOLDER = re.compile(r"(?i)(your|example|changeme|placeholder|dummy|xxx+|none|null|true|false|todo)")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    return out + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def sensitivity(name: str) -> float:
    """How far a name speaks of a secret, 0 to 1, by its parts and the listed words that they end with (dbpwd)."""
    own = []
    for part in (p.lower() for p in _PARTS.findall(name)):
        end = len(part)
        while last := max((w for w in SENSITIVE if part.endswith(w, 0, end)), key=len, default=""):
            own.append(SENSITIVE[last])
            end -= len(last)
    return max(ALONE, min(1.0, sum(sorted(own, reverse=True)[:2]))) if own else 0.0


def entropy(literal: str) -> float:
    """Bits a character."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values()) if n else 0.0


def literal_score(literal: str) -> float:
    """How far a literal looks like a secret, 0 to 1."""
    if len(literal) < LEAST_CHARS or _PLACEHOLDER.match(literal) or re.search(r"\s", literal):
        return 0.0
    kinds = sum(bool(re.search(p, literal)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, entropy(literal) / 4 * (0.55 + 0.15 * kinds))


class _Lexed:
    """A text's tokens, (kind, start, end) without white space, and the pairs that they make."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [(m.lastgroup if m.lastgroup != "q" else "string", m.start(), m.end()) for m in _TOKEN.finditer(text) if m.lastgroup != "space"]
        self.keys: dict[int, str | None] = {}
        self.weights: dict[str, float] = {}
        self.colons: list[int] = []  # by token: the last colon up to it that no line, string, comma, semicolon or bracket ( or { follows, else -1
        last = -1
        for i, (kind, a, b) in enumerate(self.tokens):
            if kind in ("line", "string") or text[a] in ",;({":
                last = -1
            elif b - a == 1 and text[a] == ":":
                last = i
            self.colons.append(last)

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else "line"

    def word(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]] if 0 <= i < len(self.tokens) else ""

    def inside(self, i: int) -> tuple[int, int]:
        """The place of a string's content."""
        _, a, b = self.tokens[i]
        n = 3 if b - a >= 6 and self.text[a : a + 3] in ('"""', "'''") else 1
        return a + n, b - n

    def key(self, i: int) -> str | None:
        """The name that ends with token ``i``: a plain one, a quoted one, or that of an index."""
        if i not in self.keys:
            self.keys[i] = self._key(i)
        return self.keys[i]

    def _key(self, i: int) -> str | None:
        if self.kind(i) == "name":
            return self.word(i)
        if self.kind(i) == "string":
            a, b = self.inside(i)
            return self.text[a:b] if _KEY.fullmatch(self.text, a, b) else None
        if self.word(i) == "]" and self.kind(i - 1) in ("string", "name"):
            return self.key(i - 1)
        return None

    def weight(self, name: str) -> float:
        """Its sensitivity, reckoned once: many signs of a line may share a name."""
        if name not in self.weights:
            self.weights[name] = sensitivity(name)
        return self.weights[name]

    def assigned(self, i: int) -> str | None:
        """The name that the sign ``i`` assigns to, behind its annotation if there is one, however long."""
        found = [self.key(i - 1)]
        if self.word(i) in ("=", "=>") and i >= 2 and self.colons[i - 2] >= 0:  # name: type = value, but in prose the word in front may be the name
            found.append(self.key(self.colons[i - 2] - 1))
        return max(filter(None, found), key=self.weight, default=None)

    def values(self, i: int) -> tuple[list[tuple[int, int, bool]], int]:
        """(start, end, quoted) of what stands behind the sign ``i``, and the token behind it."""
        out: list[tuple[int, int, bool]] = []
        j = i + 1
        if self.kind(j) == "name" and self.word(j + 1) == "(" and self.tokens[j + 1][1] == self.tokens[j][2]:
            return self.bracketed(j + 1)
        if self.word(j) == "(":
            return self.bracketed(j)
        if self.word(j) in ("|", ">") and self.kind(j + 1) == "line":
            return self.block(j)
        prefix = self.kind(j) == "name" and self.kind(j + 1) == "string" and len(self.word(j)) <= 2 and self.tokens[j + 1][1] == self.tokens[j][2]
        j += prefix
        if self.kind(j) == "string":
            while self.kind(j) == "string":  # joined by standing side by side or by +
                out.append((*self.inside(j), True))
                j += 2 if self.word(j + 1) == "+" and self.kind(j + 2) == "string" else 1
            return out, j
        if self.kind(j) not in ("line", "open", "close"):
            start = self.tokens[j][1]
            if self.kind(j + 1) == "open" and self.tokens[j + 1][1] == self.tokens[j][2]:
                return out, j + 1  # a type or an indexed name
            if m := _BARE.match(self.text, start):
                while j < len(self.tokens) and self.tokens[j][1] < m.end():
                    j += 1
                return [(start, m.end(), False)], j
        return out, i + 1

    def bracketed(self, i: int) -> tuple[list[tuple[int, int, bool]], int]:
        """The strings within the brackets that token ``i`` opens, but for keys and values of their own.

        It reads as far as the next sign at most, from which the next pair is read, so no token is read twice.
        """
        out, depth, j = [], 0, i
        while j < len(self.tokens):
            depth += (self.kind(j) == "open") - (self.kind(j) == "close")
            if not depth:
                break
            if self.kind(j) == "set":
                return out, i + 1  # it holds pairs: they are read one by one
            if self.kind(j) == "string" and self.kind(j + 1) != "set":
                out.append((*self.inside(j), True))
            j += 1
        return out, j + 1

    def block(self, j: int) -> tuple[list[tuple[int, int, bool]], int]:
        """The lines of a block scalar, those that are indented further than the line of its name."""
        indent = lambda at: _INDENT.match(self.text, at).end() - at
        begin = self.text.rfind("\n", 0, self.tokens[j][1]) + 1
        own, at, out = indent(begin), self.tokens[j + 1][2] if j + 1 < len(self.tokens) else len(self.text), []
        while at < len(self.text):
            end = self.text.find("\n", at)
            end = len(self.text) if end < 0 else end
            if indent(at) <= own:
                break
            out.append((at + indent(at), end, True))
            at = end + 1
        while j < len(self.tokens) and self.tokens[j][1] < at:
            j += 1
        return out, j


def pairs(text: str, lexed: _Lexed | None = None) -> list[tuple[str, str, int, int, bool]]:
    """(name, value, start, end, quoted) of each assignment; the places are the value's."""
    lexed, out, i = lexed or _Lexed(text), [], 0
    while i < len(lexed.tokens):
        following = i + 1
        if lexed.kind(i) == "set" and (name := lexed.assigned(i)):
            found, following = lexed.values(i)
            for a, b, quoted in found:
                value = text[a:b]
                hole = _HOLE.match(value)
                out.append((name, hole[1] if hole else value, a, b, quoted and not hole))
        i = max(following, i + 1)
    return out


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of literals that a sensitive name takes, directly or by constants."""
    lexed = _Lexed(text)
    found = pairs(text, lexed)
    names = {name: lexed.weight(name) for name, *_ in found}
    behind: dict[str, list[str]] = {}
    for name, value, _, _, quoted in found:
        if not quoted and _NAME.match(value) and value in names:
            behind.setdefault(name, []).append(value)
    # a = b hands a's sensitivity to the literals of b; the highest first, so that each name is handed on with its final one
    for level in sorted(set(names.values()), reverse=True):
        open_names = [name for name in behind if names[name] == level]
        while open_names:
            for value in behind.get(open_names.pop(), ()):
                if names[value] < level:
                    names[value] = level
                    open_names.append(value)
    out = []
    for name, value, start, end, quoted in found:
        if not quoted and value in names:
            continue
        if names[name] * (0.4 + 0.6 * literal_score(value)) >= THRESHOLD * 0.7 and literal_score(value) > 0:
            out.append((start, end, "pair"))
    return out


def joined(spans) -> str:
    rank = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], rank[s[2]], s[1])))


def _row(text: str, may_hold: bool, may_pair: bool) -> tuple:
    base = base_spans(text) if may_hold else []
    more = lexed_spans(text) if may_pair else []
    counts = Counter(k for _, _, k in base)
    return counts["assign"], counts["access"], counts["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)


def _scanned(batches):
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for part in slices(batch, "text"):
            texts = texts_of(part)
            may_hold = pc.match_substring_regex(texts, MAY_HOLD).to_pylist()
            may_pair = pc.match_substring_regex(texts, MAY_PAIR).to_pylist()
            nothing = _row("", False, False)
            rows = [_row(texts[i].as_py(), a, b) if a or b else nothing for i, (a, b) in enumerate(zip(may_hold, may_pair))]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    ``spans`` lists kind:start:end of all spans by start, in code points, end
    exclusive; ``base_sha256`` is the digest of the base kinds' list.  Null texts
    are empty texts, which have no spans.  Repeated rows and ties have the same
    spans; texts, words and lines of any length are read whole, in linear time.
    No rows give no rows; other columns are not looked at.
    """
    return docs.select("doc_id", "text").mapInArrow(partial(_scanned), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
