"""Benchmark decontamination with a generalised suffix automaton (operator 9).

The normalised words of all benchmark items are inserted into one automaton.
Documents stream through it; the length of the longest match that ends at each
word tells which words lie in an occurrence of a benchmark window.

Normalisation: A-Z is lower-cased, words are maximal runs of digits, a-z and
non-ASCII characters.  A window is ``window`` consecutive words of an item; an
item of fewer words, but not none, is one window.

Defined cases: null or word-less text has no words and is never contaminated;
repeated rows give repeated results; null item ids count as no item but their
text still marks words; an empty benchmark hits nothing.  Extra columns of the
inputs are ignored.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.llm.common import materialize, row_key, shared_model, small

WINDOW = 13
#: Words of benchmark items that one automaton may hold; more items go in further passes.
MAX_AUTOMATON_WORDS = 100_000

_KEEP = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if (b in _KEEP or 0x41 <= b <= 0x5A) else 0x20 for b in range(256))
_WORD = re.compile(rb"[0-9a-zA-Z\x80-\xff]+")


def words_of(data: bytes) -> list[bytes]:
    """Normalised words of UTF-8 bytes."""
    return data.translate(_TABLE).split()


class SuffixAutomaton:
    """Generalised suffix automaton over word ids, with the windows of the items on its states."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item_id, words in items:
            if words:
                ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
                coded.append((item_id, ids))
                self._insert(ids)
        self.shortest = min((min(len(ids), window) for _, ids in coded), default=0)
        self._mark(coded)

    def _insert(self, ids: list[int]) -> None:
        last = 0
        for c in ids:
            last = self._extend(last, c)

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """Clone q for the strings that end with p's string and c."""
        clone = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur, p = self._new(self.length[last] + 1, {}, 0), last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _ancestor(self, state: int, length: int) -> int:
        """The state that holds the suffix of that length."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        self.full: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, set]]] = {}
        for item_id, ids in coded:
            state, n = 0, min(len(ids), self.window)
            for i, c in enumerate(ids):
                state = self.next[state][c]
                if i + 1 < n:
                    continue
                at = self._ancestor(state, n)
                if n == self.window:
                    self.full.setdefault(at, set()).add(item_id)
                else:
                    marks = dict(self.short.get(at, []))
                    marks.setdefault(n, set()).add(item_id)
                    self.short[at] = sorted(marks.items())
        self.to_full = [-1] * len(self.length)
        self.to_short = [-1] * len(self.length)
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
            up = self.link[s]
            self.to_full[s] = s if s in self.full else self.to_full[up]
            self.to_short[s] = s if s in self.short else self.to_short[up]

    def scan(self, ids: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Covered word ranges [start, end) and the items whose windows occur."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        ranges, found = [], set()
        state = matched = 0
        for i, c in enumerate(ids):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c not in nxt[state]:
                continue
            state = nxt[state][c]
            matched += 1
            cover = 0
            if matched >= window:
                cover = matched
                # The windowed suffix sits on this state or above; deeper marks stay for longer strings.
                at = self.to_full[state]
                if at >= 0:
                    found |= self.full[at]
            at = self.to_short[state]
            while at >= 0:
                for n, items in self.short[at]:
                    if n <= matched:
                        cover = max(cover, n)
                        found |= items
                at = self.to_short[link[at]]
            if cover:
                while ranges and ranges[-1][0] >= i + 1 - cover:
                    ranges.pop()
                if ranges and ranges[-1][1] >= i + 1 - cover:
                    ranges[-1] = (ranges[-1][0], i + 1)
                else:
                    ranges.append((i + 1 - cover, i + 1))
        return ranges, found


def _scan_document(auto: SuffixAutomaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Only runs of known words at least as long as the shortest window go through the automaton."""
    least = auto.shortest
    if not least or len(words) < least:
        return [], set()
    ids = np.fromiter(map(auto.vocab.get, words, repeat(-1)), dtype=np.int64, count=len(words))
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    long = np.flatnonzero(ends - starts >= least)
    ranges, found = [], set()
    for a, b in zip(starts[long].tolist(), ends[long].tolist()):
        r, f = auto.scan(ids[a:b].tolist())
        ranges += [(a + x, a + y) for x, y in r]
        found |= f
    return ranges, found


def _char_spans(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code-point spans of word ranges."""
    at = [(m.start(), m.end()) for m in _WORD.finditer(data)]
    return [(len(data[: at[a][0]].decode()), len(data[: at[b - 1][1]].decode())) for a, b in ranges]


_SCHEMA = (
    "__key long, {id} {id_type}, n_words long, ranges array<struct<start:long,end:long>>, "
    "spans array<struct<start:long,end:long>>, items array<string>"
)


def _one_pass(docs: DataFrame, auto: SuffixAutomaton, id_col: str) -> DataFrame:
    spark = docs.sparkSession
    shared = shared_model(spark, auto)
    id_type = docs.schema[id_col].dataType
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        a = shared()
        for batch in small(batches):
            texts = batch.column(2).cast(pa.binary()).to_pylist()
            n, ranges, spans, items = [], [], [], []
            for data in texts:
                words = words_of(data) if data else []
                r, f = _scan_document(a, words)
                n.append(len(words))
                ranges.append([{"start": x, "end": y} for x, y in r])
                spans.append([{"start": x, "end": y} for x, y in _char_spans(data, r)] if r else [])
                items.append(sorted(x for x in f if x is not None))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ranges, pair), pa.array(spans, pair), pa.array(items, pa.list_(pa.string()))],
                names=["__key", id_col, "n_words", "ranges", "spans", "items"],
            )

    return docs.mapInArrow(run, _SCHEMA.format(id=f"`{id_col}`", id_type=id_type.simpleString()))


def _united(ranges) -> list[tuple[int, int]]:
    out = []
    for a, b in sorted((r["start"], r["end"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _items(benchmark: DataFrame, item_col: str, text_col: str, max_automaton_words: int) -> tuple[DataFrame, int]:
    """The items and the number of shards that hold them: a shard has about ``max_automaton_words`` words of the usual length."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("t")).where("t IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    return items, max(1, -(-int(size) // (6 * max_automaton_words)))


def _automaton(items: DataFrame, k: int, shards: int, window: int) -> SuffixAutomaton:
    part = items if shards == 1 else items.where(F.pmod(F.xxhash64("t", "item"), F.lit(shards)) == k)
    return SuffixAutomaton([(r["item"], words_of(r["t"].encode())) for r in part.toLocalIterator()], window)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_automaton_words: int = MAX_AUTOMATON_WORDS,
) -> DataFrame:
    """One row a document: id, n_words, n_hit, items (sorted strings), spans (code points [start, end) of hit runs).

    The automaton is broadcast only as far as ``max_automaton_words`` goes; a
    larger benchmark is dealt into shards of items, one pass each, whose hits
    are written to the shared folder and united.
    """
    items, shards = _items(benchmark, item_col, item_text_col, max_automaton_words)
    source = docs.select(row_key(id_col, text_col).alias("__key"), F.col(id_col), F.col(text_col).cast("string").alias("__text"))

    if shards == 1:
        found = _one_pass(source, _automaton(items, 0, 1, window), id_col)
        return found.select(
            id_col, "n_words", F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"]).alias("n_hit"), "items", "spans"
        )
    passes = [materialize(_one_pass(source, _automaton(items, k, shards, window), id_col).where((F.size("ranges") > 0) if k else F.lit(True)), "decontaminate") for k in range(shards)]
    first, rest = passes[0], passes[1:]
    more = rest[0]
    for p in rest[1:]:
        more = more.unionByName(p)
    # Repeated rows share a key and have equal hits, so one row of each pass and key stands for them.
    more = more.dropDuplicates(["__key", "ranges", "items"]).groupBy("__key").agg(
        F.flatten(F.collect_list("ranges")).alias("r2"), F.flatten(F.collect_list("spans")).alias("s2"), F.flatten(F.collect_list("items")).alias("i2")
    )

    @F.pandas_udf("array<struct<start:long,end:long>>")
    def united(ranges):
        return ranges.map(lambda v: [{"start": a, "end": b} for a, b in _united(v)])

    with_more = lambda a, b: united(F.concat(a, F.coalesce(b, F.array().cast("array<struct<start:long,end:long>>"))))
    whole = first.join(more, "__key", "left").select(
        F.col(id_col),
        "n_words",
        with_more("ranges", "r2").alias("ranges"),
        with_more("spans", "s2").alias("spans"),
        F.array_sort(F.array_distinct(F.concat("items", F.coalesce("i2", F.array().cast("array<string>"))))).alias("items"),
    )
    return whole.select(
        id_col, "n_words", F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"]).alias("n_hit"), "items", "spans"
    )


def contaminated(n_hit, n_words):
    """The contract's rule: some word is hit, and at least one in twenty."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the contaminated rows; all columns stay."""
    return _with_hits(docs, benchmark, text_col, "drop")


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_span_words: int = WINDOW, max_coverage: float = 0.05, text_col: str = "text") -> DataFrame:
    """``docs`` with hit runs cut from the text where a run has ``max_span_words`` words or more, or the hits together exceed ``max_coverage``."""
    return _with_hits(docs, benchmark, text_col, "cut", max_span_words, max_coverage)


def _with_hits(docs, benchmark, text_col, how, max_span_words=WINDOW, max_coverage=0.05, max_automaton_words=MAX_AUTOMATON_WORDS):
    """The rows pass the automaton once and are not shuffled; a benchmark of several shards joins their united hits by row key."""
    items, shards = _items(benchmark, "item_id", "text", max_automaton_words)
    if shards == 1:
        return _apply(docs, _automaton(items, 0, 1, WINDOW), text_col, how, max_span_words, max_coverage)
    keyed = docs.withColumn("__wf_key", row_key(text_col, text_col))
    found = find_contamination(keyed, benchmark, id_col="__wf_key", text_col=text_col, max_automaton_words=max_automaton_words)
    found = materialize(found.where("n_hit > 0").dropDuplicates(["__wf_key"]), "contaminated")
    if how == "drop":
        bad = found.where(contaminated(F.col("n_hit"), F.col("n_words"))).select("__wf_key")
        return keyed.join(bad, "__wf_key", "left_anti").select(*docs.columns)
    hit = found.select("__wf_key", F.col("spans").alias("__wf_spans"), (F.col("n_hit") > max_coverage * F.col("n_words")).alias("__wf_all"))
    text = F.col(text_col)
    # Cut from the last span to the first, so that earlier offsets stay valid.
    cut = F.aggregate(
        F.reverse(F.filter("__wf_spans", lambda r: F.col("__wf_all") | (F.size(F.split(F.substring(text, (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")), "[^0-9a-zA-Z\\x{80}-\\x{10FFFF}]+")) >= max_span_words))),
        text,
        lambda t, r: F.concat(F.substring(t, F.lit(1), r["start"].cast("int")), F.substring(t, (r["end"] + 1).cast("int"), F.length(t))),
    )
    joined = keyed.join(hit, "__wf_key", "left")
    return joined.select(*[(F.when(F.col("__wf_spans").isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(c)) for c in docs.columns])


def _apply(docs, auto, text_col, how, max_span_words, max_coverage):
    shared = shared_model(docs.sparkSession, auto)
    at = docs.columns.index(text_col)

    def run(batches):
        a = shared()
        for batch in small(batches):
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            keep, new = [], []
            for data in texts:
                words = words_of(data) if data else []
                ranges, _ = _scan_document(a, words)
                hit = sum(y - x for x, y in ranges)
                keep.append(not (hit and hit * 20 >= len(words)))
                if how == "cut" and ranges:
                    cut = ranges if hit > max_coverage * len(words) else [r for r in ranges if r[1] - r[0] >= max_span_words]
                    text, out, last = data.decode(), [], 0
                    for x, y in _char_spans(data, cut):
                        out.append(text[last:x])
                        last = y
                    data = ("".join(out) + text[last:]).encode()
                new.append(data)
            if how == "drop":
                yield batch.filter(pa.array(keep, pa.bool_()))
            else:
                kind = batch.schema.field(at)
                yield batch.set_column(at, kind, pa.array(new, pa.binary()).cast(kind.type))

    return docs.mapInArrow(run, docs.schema)
