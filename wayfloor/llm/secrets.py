"""Secret scan with assignment-aware lexing (operator 8).

Three base patterns are searched in every text.  Beyond them a lexer (``lexing``)
reads source and configuration syntax into name-literal pairs and follows names
that stand for other literals; each literal is scored by how sensitive its
target name is and how much it looks like a credential.  Literals over the
threshold become spans of kind ``lexed``, those of a sum or a block one span
each; base spans always stay.  A text that holds no sensitive word anywhere has
no sensitive target and is not lexed.

Spans are code points, the end exclusive.  Defined cases: null text is empty
and has no spans; repeated rows give repeated results; a literal that equals a
base span in place is reported in both kinds.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.llm.common import small
from wayfloor.llm.lexing import Reader, Values

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "lexed")

#: Words of a target name that mark its value as sensitive, with weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9,
    "private": 0.6, "access": 0.4, "auth": 0.6, "bearer": 0.8, "key": 0.4, "api": 0.3, "client": 0.2, "signing": 0.5, "encryption": 0.5, "pass": 0.7,
}
#: Words that say the value only describes a secret.
HARMLESS = {"name", "id", "type", "length", "size", "count", "url", "path", "file", "limit", "expires", "ttl", "hint", "label", "public"}
PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*+|\.+|<.*>|\$\{.*\}|\{.*\}|%.*%|your[_-].*|changeme|example|none|null|true|false|todo|redacted|\[redacted\])$")
LEXED_THRESHOLD = 1.0

_HEX_RUN = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)
_ACCESS = re.compile(ACCESS)
_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.A)
#: Sensitive words of which no other is a part: one of them is in every sensitive name.
_HINTS = sorted(w for w in SENSITIVE if not any(o != w and o in w for o in SENSITIVE))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the base patterns; matches that are too short are dropped."""
    out = []
    low = text.lower()
    if "pass" in low or "secret" in low or "token" in low or "api" in low:
        out += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), 2) for m in _HEX_RUN.finditer(text)]
    return out


def name_score(name: str) -> float:
    """How sensitive a target name is: the weights of its words, nothing if it names a property of a secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[-1] in HARMLESS:
        return 0.0
    return sum(SENSITIVE.get(w, 0.0) for w in words)


@dataclass
class Look:
    """What a score needs to know of a value: of a sum, of all its parts."""

    length: int = 0  #: up to 16
    characters: frozenset = frozenset()  #: up to 96 of them
    blank: bool = False
    placeholder: bool = False  #: of a single literal
    best: float = 0.0  #: the best score of a part alone

    def plus(self, other: Look) -> Look:
        if not other.length:
            return self
        if not self.length:
            return other
        characters = self.characters if other.characters <= self.characters else frozenset(sorted(self.characters | other.characters)[:96])
        return Look(min(16, self.length + other.length), characters, self.blank or other.blank, False, max(self.best, other.best))

    def score(self) -> float:
        """How much it looks like a credential: length, mixture and variety of characters."""
        if self.length < ASSIGN_LEAST or self.blank or self.placeholder:
            return 0.0
        classes = sum(any(test(c) for c in self.characters) for test in _CLASSES)
        return 0.3 * classes * min(1.0, len(self.characters) / self.length)


_LOWER, _UPPER, _DIGIT = (frozenset(x) for x in (string.ascii_lowercase, string.ascii_uppercase, string.digits))
_CLASSES = (_LOWER.__contains__, _UPPER.__contains__, _DIGIT.__contains__, lambda c: c not in _LOWER and c not in _UPPER and c not in _DIGIT)


def look_of(value: str) -> Look:
    look = Look(min(16, len(value)), frozenset(sorted(set(value))[:96]), " " in value, bool(PLACEHOLDER.match(value)))
    look.best = look.score()
    return look


def lexed_spans(text: str) -> list[tuple[int, int, int]]:
    """Literals of assignments whose target name, or a name they flow to, is sensitive.

    A name may stand for a sum of sums; every reference, literal and pair is
    looked at once, whatever leads to it.
    """
    low = text.lower()
    if not any(w in low for w in _HINTS):
        return []
    reader = Reader(text)
    reader.read()
    by_name = {i: s for i, p in enumerate(reader.pairs) if (s := max(map(name_score, p.names)))}
    if not by_name:
        return []
    values = Values(reader)
    looks: dict[int, Look] = {}
    of_span: dict[tuple[int, int], Look] = {}
    for found in values.classes(list(by_name)):
        inside, look = set(found), Look()
        for i in sorted(found):
            for span in values.literals[i]:
                if span not in of_span:
                    of_span[span] = look_of(text[slice(*span)])
                look = look.plus(of_span[span])
            for j in dict.fromkeys(values.leads[i]):
                if j not in inside:
                    look = look.plus(looks[j])
        looks.update(dict.fromkeys(found, look))
    secret = [i for i, s in by_name.items() if (v := max(looks[i].score(), looks[i].best)) and s + v >= LEXED_THRESHOLD]
    return [(a, b, 3) for a, b in values.reached(secret) if b > a]


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """All spans by start, then kind as listed, then end."""
    return sorted(base_spans(text) + lexed_spans(text), key=lambda s: (s[0], s[2], s[1]))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and ``spans array<struct<kind, start, end>>`` in order."""
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in small(batches):
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in spans_of(t)] if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{id_col}` {id_type}, spans array<struct<kind:string,start:long,end:long>>")


def secrets_digest(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(F.concat_ws(",", F.transform(base, shown)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", shown)).alias("spans"),
    )


def redact_text(text: str, mark: str) -> str:
    out, last = [], 0
    for a, b, _ in spans_of(text):
        if b <= last:
            continue
        if a >= last:
            out += [text[last:a], mark]
        last = b
    return "".join(out) + text[last:]


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span, base or lexed, replaced by ``mark``; spans that overlap become one mark."""
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in small(batches):
            new = [redact_text(t, mark) if t else t for t in batch.column(at).to_pylist()]
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array(new, field.type))

    return docs.mapInArrow(run, docs.schema)


def digest_of(text: str) -> str:
    return hashlib.sha256(joined([s for s in spans_of(text) if s[2] < 3]).encode()).hexdigest()
