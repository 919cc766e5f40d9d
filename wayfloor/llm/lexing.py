"""Name-literal pairs of source and configuration syntax, with constants followed (operator 8).

A lexer reads strings (prefixed, triple, raw), names (dotted, dashed), marks and
line ends; comments are read like code, since what is commented out leaks as
well.  A reader over the tokens then knows these targets of a literal:

* ``name = literal`` and its kin ``:=``, ``:``, ``=>``, ``?=``, chains of them, and pairs inside a bare literal;
* a type between: ``name: T = literal``, ``var name T = literal``, ``T name[] = literal``;
* ``name["key"] = literal``, ``"key": literal``, ``define("key", literal)``, ``#define name literal``, ``ENV name literal``;
* XML: ``<name>literal</name>``, ``name="literal"``, and ``key="name" value="literal"``;
* YAML blocks: ``name: |`` and the lines indented below.

A literal may be a sum of literals and names, or stand in a call.  A bare literal
counts only where a configuration line would have it: its name begins a line
or an item, and nothing but a comment or a mark follows.  A name stands for the
last value given to it before, in a scope (braces, or ``def`` and ``class`` by
indentation) that its use can see; failing that, for the first given after.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<triple>[bBrRfFuU]{0,2}(?:\"\"\"|'''))
    |(?P<string>(?:[bBrRfFuU]{1,2}|[$@L])?"|(?:[bBrRfFuU]{1,2}|L)?'|`)
    |(?P<name>[A-Za-z_$][\w$]*+(?:(?:\.|::|->|-(?!>))[A-Za-z_$][\w$]*+)*+)
    |(?P<number>\d[\w.]*+)
    |(?P<line>\n)
    |(?P<op>:=|=>|\?=|[=!<>]=|::|->|&&|\|\||[^\s\w])""",
    re.X | re.S | re.A,
)
#: From behind the mark that opens a string to behind the one that closes it.
_CLOSING = {
    '"""': re.compile(r'(?:[^\\"]|\\.|"(?!""))*+"""', re.S), "'''": re.compile(r"(?:[^\\']|\\.|'(?!''))*+'''", re.S),
    '"': re.compile(r'(?:[^"\\\n]|\\.)*+"', re.S), "'": re.compile(r"(?:[^'\\\n]|\\.)*+'", re.S), "`": re.compile(r"[^`]*+`"),
}
_BARE = re.compile(r"""(?:(?!&[\w.\-]+=)[^\s"'`,;#(){}\[\]<>])+""")
_AFTER_BARE = re.compile(r"[ \t]*(?:$|[\n,;#)}\]&<]|//|\\\n)")
_TAG = re.compile(r"<(/?)([A-Za-z_][\w.:\-]*+)(\s[^<>]*+)?>", re.A)
_INSIDE = re.compile(r"<([^<>]*+)")
_ATTRIBUTE = re.compile(r"""([\w.:\-]++)(?:\s*+=\s*+(?:"([^"<>]*+)"|'([^'<>]*+)'))?+""", re.A)
_KEY_NAME, _VALUE_NAME = re.compile(r"(?:.*\W)?(?:key|name)", re.A), re.compile(r"(?:.*\W)?value", re.A)
_KEY_VALUE = re.compile(r"[\w.:\-]+", re.A)
_BLOCK = re.compile(r"[|>][+\-\d]*[ \t]*(?:#[^\n]*)?\n")
_KEY = re.compile(r"[\w.\-]{1,80}", re.A)
SEPARATORS = {"=", ":=", ":", "=>", "?="}
_OPENERS = {"export", "set", "setx", "local", "readonly", "declare", "env", "arg", "let", "const", "var", "final", "static", "public", "private", "my", "our"}
_DECLARE = {"var", "const", "let", "dim", "val", "public", "private"}
_GIVES_ELSEWHERE = re.compile(r"(?i)env|get|input|prompt|read|fetch|load|find|lookup")


@dataclass
class Pair:
    """A value given to names: spans of literals and names (with the place of their use) in order."""

    names: list[str]
    parts: list[tuple]  #: (begin, end) of a literal, or (name, place, span if the name may be a bare literal)
    at: int
    scope: int = 0


def _content(text: str, kind: str, a: int, b: int) -> tuple[int, int]:
    """The span inside the quotes of a string."""
    n = 3 if kind == "triple" else 1
    while text[a] not in "\"'`":
        a += 1
    return a + n, b - n


def _tokens(text: str) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of the tokens.

    Where a string does not end, no later one of its mark does before the place
    that the search has come to (what it skipped were escapes), so that nothing
    is searched twice.
    """
    out, at, open_until = [], 0, {}
    for m in iter(lambda: _TOKEN.search(text, at), None):
        kind, a, at = m.lastgroup, m.start(), m.end()
        if kind in ("triple", "string"):
            mark = text[at - 3 : at] if kind == "triple" else text[at - 1]
            end = _CLOSING[mark].match(text, at) if at >= open_until.get(mark, 0) else None
            if end:
                at = end.end()
            else:
                if at >= open_until.get(mark, 0):
                    line = text.find("\n", at) if mark in "\"'" else len(text)
                    open_until[mark] = _unclosed_end(text, at, mark) if mark in "\"'" and line >= 0 else len(text)
                # The mark alone; letters before it are a name, and two marks of three an empty string.
                letters = a + len(m[0]) - len(m[0].lstrip("bBrRfFuUL$@"))
                if letters > a:
                    out.append(("name" if text[a] not in "@" else "op", a, letters))
                kind, a, at = ("string", letters, letters + 2) if kind == "triple" else ("op", letters, letters + 1)
        out.append((kind, a, at))
    return out


_UNCLOSED = {q: re.compile(rf"(?:[^{q}\\\n]|\\.)*+", re.S) for q in "\"'"}


def _unclosed_end(text: str, at: int, mark: str) -> int:
    """Where the search for the end of a string without one stops."""
    return max(at, _UNCLOSED[mark].match(text, at).end())


class Reader:
    def __init__(self, text: str):
        self.text = text
        self.tokens = _tokens(text)
        self.starts = [t[1] for t in self.tokens]
        self.ops = [text[a:b] if kind == "op" else None for kind, a, b in self.tokens]
        self.pairs: list[Pair] = []
        #: Where every scope begins and ends; the first is the whole text.
        self.scopes: list[list[int]] = [[0, len(text) + 1]]

    def is_op(self, i: int, *marks: str) -> bool:
        return i < len(self.ops) and self.ops[i] in marks

    def kind(self, i: int) -> str:
        return self.tokens[i][0] if i < len(self.tokens) else "line"

    def word(self, i: int) -> str:
        return self.text[self.tokens[i][1] : self.tokens[i][2]]

    def key(self, i: int) -> str | None:
        """The name that a string token spells, if it could be one."""
        a, b = _content(self.text, *self.tokens[i])
        return self.text[a:b] if _KEY.fullmatch(self.text, a, b) else None

    def read(self) -> list[Pair]:
        open_: list[tuple[int, str, int]] = []  # (number, kind, indentation)
        begins, i, line = True, 0, 0

        def enter(kind: str, at: int, indent: int):
            open_.append((len(self.scopes), kind, indent))
            self.scopes.append([at, len(self.text) + 1])

        def leave(at: int):
            self.scopes[open_.pop()[0]][1] = at

        while i < len(self.tokens):
            kind, a, b = self.tokens[i]
            if kind == "line":
                begins, i, line = True, i + 1, b
                continue
            if begins:
                indent = a - line
                while open_ and open_[-1][1] == "def" and indent <= open_[-1][2]:
                    leave(a)
            word = self.text[a:b]
            if kind == "op" and word in "{}":
                if word == "{":
                    enter("{", a, 0)
                elif open_ and open_[-1][1] == "{":
                    leave(b)
            if begins and kind == "name" and word in ("def", "class", "async"):
                enter("def", a, indent)
            was, i = i, i + 1 if kind in ("op", "number") else self.target(i, begins, open_[-1][0] if open_ else 0)
            if kind != "op":
                for j in range(was, min(i, len(self.tokens))):  # a value may hold line ends
                    if self.tokens[j][0] in ("line", "string", "triple") and (end := self.text.rfind("\n", *self.tokens[j][1:])) >= 0:
                        line = end + 1
            begins = begins and (kind == "op" and word in "-#/*;{," or kind == "name" and word.lower() in _OPENERS) or kind == "op" and word in "{,;&?("
        self.tags()
        self.pairs.sort(key=lambda p: p.at)
        return self.pairs

    def tags(self):
        """Pairs of elements that hold text alone, and of key and value attributes of one tag."""
        before = None
        for m in _TAG.finditer(self.text):
            if before and m[1] and not before[1] and m[2] == before[2]:
                inner = self.text[before.end() : m.start()]
                if inner.strip() and "<" not in inner and ">" not in inner:
                    begin = before.end() + len(inner) - len(inner.lstrip())
                    self.pairs.append(Pair([m[2]], [(begin, begin + len(inner.strip()))], before.start()))
            before = m
        for m in _INSIDE.finditer(self.text):
            key = None
            for found in _ATTRIBUTE.finditer(self.text, *m.span(1)):
                value = 2 if found[2] is not None else 3
                if found[value] is None:
                    continue
                if key is None and _KEY_NAME.fullmatch(found[1]) and _KEY_VALUE.fullmatch(found[value]):
                    key = found[value]
                elif key is not None and _VALUE_NAME.fullmatch(found[1]):
                    self.pairs.append(Pair([key], [found.span(value)], m.start()))
                    break

    def target(self, i: int, begins: bool, scope: int) -> int:
        """Read a pair if one starts at token i; the token to go on with."""
        names: list[str] = []
        start, at = i, self.tokens[i][1]
        while True:
            found = self.one_target(i)
            if not found:
                break
            name, j = found
            names.append(name)
            if self.kind(j) == "name" and self.one_target(j):  # the next target of a chain, or a pair in a bare literal
                i = j
                continue
            parts, end, bare = self.value(j)
            if bare:
                k = bisect_right(self.starts, bare[0] - 1)
                reference = self.kind(k) == "name" and self.tokens[k][1:] == bare
                alone = begins and _AFTER_BARE.match(self.text, bare[1])
                if reference:
                    self.pairs.append(Pair(names, [(self.text[slice(*bare)], bare[0], bare if alone else None)], at, scope))
                elif alone:
                    self.pairs.append(Pair(names, [bare], at, scope))
                return max(start + 1, bisect_right(self.starts, bare[1] - 1))
            if parts:
                self.pairs.append(Pair(names, parts, at, scope))
                return max(start + 1, end)
            break
        return max(start, i) + 1

    def one_target(self, i: int) -> tuple[str, int] | None:
        """(name, token of the value) if a target and its separator stand at token i."""
        kind = self.kind(i)
        if kind not in ("name", "string"):
            return None
        name = self.word(i) if kind == "name" else self.key(i)
        if not name:
            return None
        low, j = name.lower(), i + 1
        if kind == "name" and low in ("define", "setenv", "env", "setx") and j < len(self.tokens):
            open_ = self.is_op(j, "(")
            j += open_
            if self.kind(j) in ("name", "string"):
                key = self.word(j) if self.kind(j) == "name" else self.key(j)
                k = j + 1 + self.is_op(j + 1, ",")
                if key and self.kind(k) != "line" and not self.is_op(k, *SEPARATORS) and (open_ or self.kind(j) == "name"):
                    return key, k
            j = i + 1
        if kind == "name" and low in _DECLARE and self.kind(j) == "name":  # a type between name and sign
            k = self.type_end(j + 1)
            if k and k > j + 1:
                return self.word(j), k + 1
        path = [name]
        while self.is_op(j, "["):
            if self.kind(j + 1) == "string" and self.is_op(j + 2, "]"):
                path.append(self.key(j + 1) or "")
                j += 3
            elif self.is_op(j + 1, "]"):
                j += 2
            elif self.kind(j + 1) in ("number", "name") and self.is_op(j + 2, "]"):
                j += 3
            else:
                return None
        name = ".".join(path)
        if self.is_op(j, "?", "!") and self.is_op(j + 1, ":"):
            j += 1
        if not self.is_op(j, *SEPARATORS):
            return None
        if self.is_op(j, ":"):
            if self.tokens[j][2] < len(self.text) and self.text[self.tokens[j][2]] == "/":  # a URL
                return None
            k = self.type_end(j + 1)
            joined = k == j + 2 and self.tokens[j][1] == self.tokens[j - 1][2] and self.tokens[k][1] == self.tokens[j][2] + len(self.word(j + 1))
            if k and not joined:  # a:b=c is a pair in a bare literal
                return name, k + 1
        return name, j + 1

    def type_end(self, i: int) -> int | None:
        """The token of the equals sign that a type at token i is followed by."""
        depth = 0
        for j in range(i, min(i + 24, len(self.tokens))):
            kind = self.kind(j)
            if kind == "op":
                word = self.word(j)
                if word in ("=", ":=") and depth == 0:
                    return j
                if word in "[<(":
                    depth += 1
                elif word in "]>)":
                    depth -= 1
                    if depth < 0:
                        return None
                elif word not in "|&*?." and not (word in "," and depth) and word not in ("::", "->"):
                    return None
            elif kind != "name":
                return None
        return None

    def value(self, i: int) -> tuple[list[tuple], int, tuple[int, int] | None]:
        """(parts, next token, span of a bare literal) of what stands at token i."""
        parts: list[tuple] = []
        text, depth = self.text, 0
        before = self.tokens[i - 1][2] if i else 0
        m = _BLOCK.match(text, before + len(text[before : before + 80]) - len(text[before : before + 80].lstrip(" \t")))
        if m and text[self.tokens[i - 1][1]] == ":":
            return self.block(m.end(), self.tokens[i - 1][1])
        while self.is_op(i, "(") or (depth and i < len(self.tokens) and self.kind(i) == "line"):
            depth += self.is_op(i, "(")
            i += 1
        plain = not depth
        while i < len(self.tokens):
            kind, a, b = self.tokens[i]
            if kind in ("string", "triple"):
                parts.append(_content(text, kind, a, b))
                plain = False
                i += 1
            elif kind == "name" and self.is_op(i + 1, "(") and self.tokens[i + 1][1] == b and self.kind(i + 2) in ("string", "triple") and not _GIVES_ELSEWHERE.search(text, a, b):
                parts.append(_content(text, *self.tokens[i + 2]))
                plain = False
                i += 3 + self.is_op(i + 3, ")")
            elif kind == "name" and not plain:
                if self.is_op(i + 1, "("):
                    break
                parts.append((text[a:b], a, None))
                i += 1
            else:
                break
            while depth and self.kind(i) == "line" and i < len(self.tokens):
                i += 1
            if self.is_op(i, "+", ".") and i + 1 < len(self.tokens):
                i += 1
                while self.kind(i) == "line" and i + 1 < len(self.tokens):
                    i += 1
            elif self.kind(i) not in ("string", "triple") or i >= len(self.tokens):
                break
        if parts or not plain or i >= len(self.tokens) or self.kind(i) == "line":
            return parts, i, None
        bare = _BARE.match(text, self.tokens[i][1])
        if not bare or (self.kind(i) == "name" and text[bare.end() : bare.end() + 1] == "("):
            return parts, i, None
        if self.kind(i) == "name" and (self.is_op(i + 1, "+")):  # name + literal
            parts, j = [(self.word(i), self.tokens[i][1], None)], i + 2
            if self.kind(j) in ("string", "triple"):
                return [*parts, _content(text, *self.tokens[j])], j + 1, None
        return [], i, bare.span()

    def block(self, at: int, name: int) -> tuple[list[tuple], int, None]:
        """The lines of a YAML block that is indented deeper than the line of its name."""
        begin = self.text.rfind("\n", 0, name) + 1
        indent = len(self.text[begin:name]) - len(self.text[begin:name].lstrip())
        parts = []
        while at < len(self.text):
            end = self.text.find("\n", at)
            end = len(self.text) if end < 0 else end
            line = self.text[at:end]
            bare = line.strip()
            if bare:
                deep = len(line) - len(line.lstrip())
                if deep <= indent:
                    break
                parts.append((at + deep, at + deep + len(bare)))
            at = end + 1
        return parts, bisect_right(self.starts, at - 1), None


class _Given:
    """The pairs that give one name a value, by place, searched by the scopes they are in."""

    def __init__(self, pairs: list[int], reader: Reader):
        self.pairs = pairs
        self.places = [reader.pairs[i].at for i in pairs]
        scopes = [reader.scopes[reader.pairs[i].scope] for i in pairs]
        self.size = 1 << len(pairs).bit_length()  # more than there are pairs
        # Trees of the furthest end and the nearest begin of a stretch of pairs.
        far = max(e for _, e in scopes) + 1
        self.ends = [0] * self.size + [e for _, e in scopes] + [0] * (self.size - len(pairs))
        self.begins = [0] * self.size + [b for b, _ in scopes] + [far] * (self.size - len(pairs))
        for i in range(self.size - 1, 0, -1):
            self.ends[i] = max(self.ends[2 * i], self.ends[2 * i + 1])
            self.begins[i] = min(self.begins[2 * i], self.begins[2 * i + 1])

    def before(self, k: int, place: int) -> int:
        """The last pair below k whose scope ends behind the place, or -1."""
        i = k + self.size
        while i > 1:
            if i & 1 and self.ends[i - 1] > place:
                i -= 1
                while i < self.size:
                    i = 2 * i + (self.ends[2 * i + 1] > place)
                return i - self.size
            i >>= 1
        return -1

    def after(self, k: int, place: int) -> int:
        """The first pair from k on whose scope begins before the place, or -1."""
        if k >= len(self.pairs):
            return -1
        i = k + self.size
        while not self.begins[i] <= place:
            while i & 1:
                i >>= 1
            if not i:
                return -1
            i += 1
            if i & (i - 1) == 0:  # past the last one of its row
                return -1
        while i < self.size:
            i = 2 * i + (not self.begins[2 * i] <= place)
        return i - self.size


class Values:
    """What the names in the values of a text stand for: every reference is resolved once."""

    def __init__(self, reader: Reader):
        self.pairs = reader.pairs
        names: dict[str, list[int]] = {}
        for i, p in enumerate(reader.pairs):
            for n in dict.fromkeys(p.names):
                names.setdefault(n, []).append(i)
        given = {}
        self.literals: list[list[tuple[int, int]]] = []
        self.leads: list[list[int]] = []
        for p in reader.pairs:
            spans, leads = [], []
            for part in p.parts:
                if isinstance(part[0], int):
                    spans.append(part)
                    continue
                name, place, bare = part
                if name in names and name not in given:
                    given[name] = _Given(names[name], reader)
                meant = self._meant(given[name], place, part) if name in given else -1
                if meant >= 0:
                    leads.append(meant)
                elif bare:
                    spans.append(bare)
            self.literals.append(spans)
            self.leads.append(leads)

    def _meant(self, given: _Given, place: int, part: tuple) -> int:
        """The last value given before in a scope that the place can see, else the first given after; not its own."""
        at = bisect_left(given.places, place)
        k = given.before(at, place)
        while k >= 0 and self.pairs[given.pairs[k]].parts[0] == part:
            k = given.before(k, place)
        if k < 0:
            k = given.after(at, place)
            while k >= 0 and self.pairs[given.pairs[k]].parts[0] == part:
                k = given.after(k + 1, place)
        return given.pairs[k] if k >= 0 else -1

    def classes(self, pairs: list[int]) -> list[list[int]]:
        """The pairs that these lead to, in classes that lead to each other, those led to first."""
        number, low, stack, done, out = {}, {}, [], set(), []
        for root in pairs:
            if root in number:
                continue
            number[root] = low[root] = len(number)
            stack.append(root)
            work = [(root, iter(self.leads[root]))]
            while work:
                i, leads = work[-1]
                for j in leads:
                    if j not in number:
                        number[j] = low[j] = len(number)
                        stack.append(j)
                        work.append((j, iter(self.leads[j])))
                        break
                    if j not in done:
                        low[i] = min(low[i], number[j])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[i])
                    if low[i] == number[i]:
                        found = []
                        while not found or found[-1] != i:
                            found.append(stack.pop())
                        done.update(found)
                        out.append(found)
        return out

    def reached(self, pairs: list[int]) -> list[tuple[int, int]]:
        """The literals that these pairs stand for, each once."""
        seen, ring = set(pairs), list(pairs)
        spans = {}
        while ring:
            i = ring.pop()
            spans.update(dict.fromkeys(self.literals[i]))
            for j in self.leads[i]:
                if j not in seen:
                    seen.add(j)
                    ring.append(j)
        return list(spans)
