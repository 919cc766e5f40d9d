"""Substring deduplication by paragraph MinHash banding (operator 7).

A paragraph is a line of ``MIN_WORDS`` words or more, or a block of shorter
lines that holds so many words; blocks end at blank lines and at long lines,
and blocks with fewer words that follow each other are one.  Any run of shorter
lines that reaches so many words is a paragraph besides.  Lines of ``LONG_WORDS`` or more also hold passages
that begin and end at sentences, the beginnings chosen by content, so that a
passage copied into different lines is cut the same way in both.

Any run of ``PASSAGE_WORDS`` words or more that stands elsewhere too is a
paragraph as well, wherever it begins and ends and however its lines are
broken.  Every window of so many words is anchored at its least hash of
``GRAM`` words, so equal windows have equal anchors; windows whose anchor
repeats are compared by their words, one for every distinct surrounding of the
anchor.  A window belongs to the first place of its words, and windows that
keep step with one first place are one run, which is maximal.

Lines and blocks get MinHash signatures whose bands find pairs at the threshold
but for ``MISS``; those that collide are verified by exact Jaccard similarity of their
word shingles.  Runs and passages are classed by equality.  Connected
components are the classes; the first paragraph of a class, by document and
place, stays and the others are removals.  A run of windows is classed with the
run at its first place; one that overlaps that place is no removal.

A class counts if it has paragraphs of two documents: what a document repeats
of itself alone (refrains, junk of one word) is no sign of a copy.  With
``within`` such classes are returned too (the default); the query leaves them out.

Defined cases: null, empty and short texts have no paragraphs; rows that
repeat id and text count as one place, so neither is a removal of the other;
rows without a doc_id come first.  Offsets are in bytes of UTF-8 text.  Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.llm.common import discard, materialize, row_key, small
from wayfloor.llm.lsh import bands_for, link_classes
from wayfloor.llm.shingles import SHINGLE, Texts, in_parts, mix, shingle_hashes, word_hashes, words_of
from wayfloor.llm.substrings import _least

MIN_WORDS, LONG_WORDS = 20, 60
THRESHOLD, ROWS, MISS = 0.8, 4, 1e-3
BANDS = bands_for(THRESHOLD, ROWS, MISS)
#: Words of a window of a passage, and of an anchor (two shingles).
PASSAGE_WORDS, GRAM = 50, 2 * SHINGLE
MAX_BROADCAST_IDS = 1_000_000
#: Windows of a text anchored at once.
_CHUNK = 1 << 19
_TERMINAL = np.zeros(256, bool)
_TERMINAL[[0x2E, 0x21, 0x3F]] = True
#: Words whose hash values are computed at once.
_AT_ONCE = 1 << 13


def paragraphs(t: Texts) -> tuple[np.ndarray, np.ndarray, int]:
    """(begin, end, lines): word ranges of paragraphs; the first ``lines`` ranges are whole lines and blocks of short lines, in order."""
    spans, n = t.spans, len(t.spans)
    none = np.zeros(0, np.int64)
    if n < MIN_WORDS:
        return none, none, 0
    raw = np.frombuffer(t.data, np.uint8)
    line = np.searchsorted(np.flatnonzero(raw == 10), spans[:, 0])
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    last = np.concatenate((first[1:], [n]))
    doc, size = t.doc[first], last - first
    long = size >= MIN_WORDS
    # Blocks between blank lines; a long line is a block of its own, and small blocks of a text in a row are one.
    new = np.concatenate(([True], (line[first[1:]] - line[first[:-1]] > 1) | long[1:] | long[:-1]))
    little = np.diff(np.append(first[new], n)) < MIN_WORDS
    joined = little[1:] & little[:-1] & (doc[new][1:] == doc[new][:-1])
    block = first[new][np.concatenate(([True], ~joined))]
    stop = np.append(block[1:], n)
    whole = stop - block >= MIN_WORDS
    begin, end = [block[whole]], [stop[whole]]
    # Runs of short lines: from each, to the line that completes MIN_WORDS, if no long line comes before.
    short = np.flatnonzero(~long)
    if len(short):
        of_block = np.zeros(n, np.int64)
        of_block[begin[0]] = end[0]
        to = np.searchsorted(last, first[short] + MIN_WORDS)
        short, to = short[to < len(last)], to[to < len(last)]
        before = np.concatenate(([0], np.cumsum(long)))
        ok = (before[to + 1] == before[short]) & (doc[to] == doc[short]) & (of_block[first[short]] != last[to])  # a block is no run besides
        begin.append(first[short[ok]])
        end.append(last[to[ok]])
    if (size >= LONG_WORDS).any():
        stops = np.flatnonzero(_TERMINAL[raw])
        new = np.zeros(n, bool)
        new[first] = True
        new[1:] |= np.searchsorted(stops, spans[1:, 0]) > np.searchsorted(stops, spans[:-1, 1])
        here = new & np.repeat(size >= LONG_WORDS, size)
        at = np.flatnonzero(here[: n - SHINGLE + 1] & t.within(SHINGLE))
        line_of = np.repeat(np.arange(len(first)), size)[at]
        h = mix(t.shingles[at] ^ np.uint64(0xA0761D6478BD642F))
        chosen = np.zeros(len(at), bool)
        if len(at) >= 3:  # least of some three sentences in a row
            least = np.minimum(np.minimum(h[:-2], h[1:-1]), h[2:])
            same = line_of[2:] == line_of[:-2]
            for shift in (0, 1, 2):
                part = slice(shift, len(at) - 2 + shift)
                chosen[part] |= same & (h[part] == least)
        at, line_of = at[chosen], line_of[chosen]
        starts = np.concatenate((np.flatnonzero(new), [n]))
        to = starts[np.minimum(np.searchsorted(starts, at + MIN_WORDS), len(starts) - 1)]
        ok = (to - at >= MIN_WORDS) & (to <= last[line_of]) & ~((at == first[line_of]) & (to == last[line_of]))
        begin.append(at[ok])
        end.append(to[ok])
    return np.concatenate(begin), np.concatenate(end), int(whole.sum())


def anchored_windows(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, hash of the run's words, first window, last window) of the runs of windows with one anchor."""
    out = [[np.zeros(0, np.int64)] for _ in range(4)]
    width = PASSAGE_WORDS - SHINGLE  # shingles of a window, less one
    inside = t.within(PASSAGE_WORDS)
    for at in range(0, len(inside), _CHUNK):
        part, ok = t.shingles[at : at + _CHUNK + width], inside[at : at + _CHUNK]
        h = mix(part[:-SHINGLE] * np.uint64(0xD1342543DE82EF95) + part[SHINGLE:])
        place = np.uint64((1 << 20) - 1)
        anchor = (_least((h & ~place) | np.arange(len(h), dtype=np.uint64), PASSAGE_WORDS - GRAM + 1) & place).astype(np.int64)
        # Windows of two texts are parted by windows that lie in both and count in neither.
        first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1]))))
        last = np.concatenate((first[1:], [len(anchor)])) - 1
        first, last = first[ok[first]], last[ok[first]]
        words = np.array([_node(part[a : b + width + 1]) for a, b in zip(first.tolist(), last.tolist())], np.int64)
        for column, values in zip(out, (h[anchor[first]].view(np.int64), words, first + at, last + at)):
            column.append(values)
    return tuple(np.concatenate(c) for c in out)


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    a = mix(np.arange(1, k + 1, dtype=np.uint64)) | np.uint64(1)
    return a, mix(a)


def line_bands(shingles: np.ndarray, begin: np.ndarray, end: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band values (paragraph x band) of ranges of words in order that do not overlap."""
    a, b = (v[:, None] for v in _multipliers(bands * rows))
    end = end - (SHINGLE - 1)
    least = np.empty((bands * rows, len(begin)), np.uint64)
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + _AT_ONCE, side="right")))
        if j > i + 1 or end[i] - begin[i] <= _AT_ONCE:
            values = shingles[None, begin[i] : end[j - 1]] * a
            values += b
            least[:, i:j] = np.minimum.reduceat(values, np.column_stack((begin[i:j], end[i:j])).ravel()[:-1] - begin[i], axis=1)[:, ::2]
        else:  # a paragraph of very many words
            parts = [(shingles[None, x : min(x + _AT_ONCE, int(end[i]))] * a + b).min(axis=1) for x in range(int(begin[i]), int(end[i]), _AT_ONCE)]
            least[:, i] = np.minimum.reduce(parts)
        i = j
    code = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64)[:, None], (bands, len(begin)))
    for r in range(rows):
        code = mix(code * np.uint64(0xD1342543DE82EF95) + least[r * bands : (r + 1) * bands])
    return code.T.view(np.int64)


def _node(shingles: np.ndarray) -> int:
    value = xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=3)
    return value - (1 << 64) if value >= 1 << 63 else value


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, begin, end, n_words, node, bands, anchor)``: the paragraphs of every text; runs and passages have no bands.

    Rows with an anchor are runs of windows instead, from window begin to end, and node a hash of their words.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        names = [id_col, "key", "begin", "end", "n_words", "node", "bands", "anchor"]
        for batch in small(batches):
            for rows, t in in_parts(batch.column(2).cast(pa.binary()).to_pylist()):
                begin, end, lines = paragraphs(t)
                nodes = np.array([_node(t.shingles[x : y - SHINGLE + 1]) for x, y in zip(begin.tolist(), end.tolist())], np.int64)
                anchor, words, first, last = anchored_windows(t)
                of, at = t.doc[begin], t.doc[first]
                columns = (
                    (t.spans[begin, 0] - t.start[of], first - t.first[at]),
                    (t.spans[end - 1, 1] - t.start[of], last - t.first[at]),
                    (end - begin, last - first + PASSAGE_WORDS),
                    (nodes, words),
                )
                flat = [pa.array(np.concatenate(c).astype(np.int64)) for c in columns]
                offsets = BANDS * np.minimum(np.arange(len(begin) + len(anchor) + 1), lines)
                values = line_bands(t.shingles, begin[:lines], end[:lines], BANDS, ROWS).ravel()
                bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))
                anchors = pa.concat_arrays([pa.nulls(len(begin), pa.int64()), pa.array(anchor, pa.int64())])
                take = pa.array(rows[np.concatenate((of, at))], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *flat, bands, anchors], names=names)

    rows_in = docs.select(F.col(id_col), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("__text"))
    return rows_in.mapInArrow(run, f"`{id_col}` {id_type}, key long, begin long, end long, n_words long, node long, bands array<long>, anchor long")


def _line_sets(texts: DataFrame) -> DataFrame:
    """``(__text)`` -> ``(node, shingles)`` of the whole lines and blocks."""

    def run(batches):
        for batch in small(batches):
            for _, t in in_parts(batch.column(0).cast(pa.binary()).to_pylist()):
                begin, end, lines = paragraphs(t)
                parts = [t.shingles[x : y - SHINGLE + 1] for x, y in zip(begin[:lines].tolist(), end[:lines].tolist())]
                sets = [np.unique(s).tobytes() for s in parts]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in parts], pa.int64()), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def _with_texts(docs: DataFrame, lists: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``lists(key, list)`` -> ``(id, key, __text, list)``: the rows of the documents that have a list."""
    lists = materialize(lists, "lists")
    wanted = lists.select("key")
    if wanted.count() <= MAX_BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col), row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("__text"))
    return texts.join(wanted, "key", "left_semi").join(lists, "key").select(id_col, "key", "__text", "list")


def repeated_passages(docs: DataFrame, anchors: DataFrame, id_col: str, text_col: str, within: bool = True) -> DataFrame:
    """The maximal runs of ``PASSAGE_WORDS`` words or more that stand at several places, in columns as of ``repeated_paragraphs``.

    ``anchors`` are the rows of ``extract`` with an anchor.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    place = F.struct(F.col(id_col).alias("id"), F.col("key"), F.col("begin").alias("at"))
    spot = F.xxhash64("key", "begin")
    several = F.min(spot) != F.max(spot)  # rows that repeat id and text are one place
    # Written first, so that a very common anchor is a join of two tables, which Spark splits where one key has most rows.
    often = materialize(anchors.groupBy("anchor").agg(several.alias("several")).where("several").select("anchor"), "repeated-anchors")
    again = materialize(anchors.join(often, "anchor", "left_semi").select(id_col, "key", "begin", "end", "anchor", "node"), "anchors")
    kinds = materialize(
        again.groupBy("anchor", "node").agg(F.min(place).alias("first"), F.first(F.col("end") - F.col("begin")).alias("last"), several.alias("several")), "surroundings"
    )
    mixed = kinds.groupBy("anchor").count().where("count > 1").select("anchor")
    whole = kinds.where("several").join(mixed, "anchor", "left_anti").select("anchor", "node", F.lit(0).cast("long").alias("low"), F.col("last").alias("high"), "first")

    # Of anchors in different surroundings, the windows of the first place of each.
    one = kinds.join(mixed, "anchor", "left_semi").select("first.key", F.struct("anchor", "node", F.col("first.at").alias("at"), "last", "several").alias("one"))

    def cut(batches):
        width = PASSAGE_WORDS - SHINGLE + 1
        for batch in small(batches, 64):
            rows, out = [], [[], [], [], [], [], []]
            for i, data, wanted in zip(range(batch.num_rows), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                shingles = shingle_hashes(word_hashes(data))
                for w in wanted:
                    for j in range(w["last"] + 1):
                        rows.append(i)
                        at = w["at"] + j
                        for column, value in zip(out, (w["anchor"], w["node"], j, _node(shingles[at : at + width]), at, w["several"])):
                            column.append(value)
            take = pa.array(rows, pa.int64())
            kinds = [pa.int64()] * 5 + [pa.bool_()]
            flat = [pa.array(c, k) for c, k in zip(out, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *flat], names=[id_col, "key", "anchor", "node", "j", "words", "begin", "several"])

    texts = _with_texts(docs, one.groupBy("key").agg(F.collect_list("one").alias("list")), id_col, text_col)
    windows = texts.mapInArrow(cut, f"`{id_col}` {id_type}, key long, anchor long, node long, j long, words long, begin long, several boolean")
    same = Window.partitionBy("anchor", "words")
    some = F.max("several").over(same) | (F.min(spot).over(same) != F.max(spot).over(same))
    step = windows.select("anchor", "node", "j", F.min(place).over(same).alias("first"), some.alias("some")).where("some")
    # Windows of one surrounding overlap, so what lies between two that keep step with a place does so too.
    parts = step.groupBy("anchor", "node", "first.id", "first.key", (F.col("first.at") - F.col("j")).alias("shift")).agg(F.min("j").alias("low"), F.max("j").alias("high"))
    parts = parts.select("anchor", "node", "low", "high", F.struct("id", "key", (F.col("shift") + F.col("low")).alias("at")).alias("first"))

    shared = materialize(whole.unionByName(parts), "shared")
    at = again.select(id_col, "key", "begin", "anchor", "node").join(shared, ["anchor", "node"])
    at = at.select(id_col, "key", (F.col("begin") + F.col("low")).alias("a"), (F.col("begin") + F.col("high")).alias("b"), F.col("first.id").alias("first_id"), F.col("first.key").alias("to"), F.col("first.at").alias("start"))
    at = at.where((F.col("key") != F.col("to")) | (F.col("a") >= F.col("start") + PASSAGE_WORDS)).withColumn("shift", F.col("a") - F.col("start"))
    line = Window.partitionBy("key", "to", "shift").orderBy("a")
    reach = F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1))
    at = at.withColumn("new", F.coalesce((F.col("a") > reach + PASSAGE_WORDS).cast("long"), F.lit(0)))
    at = at.withColumn("n", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = at.groupBy("key", "to", "shift", "n").agg(F.first("first_id").alias("first_id"), F.min("a").alias("a"), F.max("b").alias("b"))
    start, end = F.col("a") - F.col("shift"), F.col("b") - F.col("shift")
    if not within:  # a run that another document has at its first place, too
        across = materialize(runs.where("key <> to").select("to", start.alias("x"), end.alias("y")).distinct(), "across")
        runs = runs.withColumns({"x": start, "y": end}).join(across, ["to", "x", "y"], "left_semi")
    runs = materialize(runs.select("key", "a", "b", "to", start.alias("x"), end.alias("y"), F.xxhash64("to", start, end).alias("component"), "first_id"), "passages")
    discard(often, again, kinds, shared)
    places = runs.select("key", "a", "b", "component", "first_id", F.lit(True).alias("removed")).union(
        runs.select("to", "x", "y", "component", "first_id", F.lit(False)).distinct()
    )
    out_type = f"`{id_col}` {id_type}, key long, begin long, end long, n_words long, component long, first_id {id_type}, removed boolean"

    def in_bytes(batches):
        for batch in small(batches):
            rows, out, first = [], [[], [], [], [], []], []
            for i, data, wanted in zip(range(batch.num_rows), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist()):
                spans = words_of(data)[0]
                for w in wanted:
                    rows.append(i)
                    end = w["b"] + PASSAGE_WORDS
                    for column, value in zip(out, (int(spans[w["a"], 0]), int(spans[end - 1, 1]), end - w["a"], w["component"], w["removed"])):
                        column.append(value)
                    first.append(w["first_id"])
            take = pa.array(rows, pa.int64())
            flat = [pa.array(c, pa.int64()) for c in out[:4]]
            columns = [batch.column(0).take(take), batch.column(1).take(take), *flat, pa.array(first, batch.schema.field(0).type), pa.array(out[4], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "key", "begin", "end", "n_words", "component", "first_id", "removed"])

    lists = places.groupBy("key").agg(F.collect_list(F.struct("a", "b", "component", "first_id", "removed")).alias("list"))
    return _with_texts(docs, lists, id_col, text_col).mapInArrow(in_bytes, out_type)


def repeated_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, within: bool = True) -> DataFrame:
    """The paragraphs that are not alone in their class: ``(id, key, begin, end, n_words, component, first_id, removed)``.

    ``first_id`` is the document of the paragraph that stays; without ``within``
    classes of paragraphs of one document alone are left out.
    """
    rows = materialize(extract(docs, id_col, text_col), "paragraphs")
    passages = repeated_passages(docs, rows.where("anchor IS NOT NULL"), id_col, text_col, within)
    found = rows.where("anchor IS NULL")
    nodes = materialize(
        found.where(F.size("bands") > 0).groupBy("node").agg(F.first("bands").alias("bands"), F.min("key").alias("key")), "paragraph-nodes"
    )

    def fetch(ids: DataFrame) -> DataFrame:
        wanted = nodes.join(ids, "node", "left_semi").select("key").distinct()
        if ids.count() <= MAX_BROADCAST_IDS:
            wanted, ids = F.broadcast(wanted), F.broadcast(ids)
        texts = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("__text")).join(wanted, "key", "left_semi")
        return _line_sets(texts.select("__text")).join(ids, "node", "left_semi").dropDuplicates(["node"])

    labels = link_classes(nodes.select("node", "bands"), fetch, threshold)
    discard(nodes)
    where = F.struct(F.col(id_col).alias("id"), F.col("key"), F.col("begin"), F.col("end"))
    # Classes are summed up by words first, so that rows are joined once and no class meets in one task.
    sums = (F.min("first").alias("first"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    each = found.select("node", where.alias("first"), F.lit(1).alias("n"), F.col("key").alias("low"), F.col("key").alias("high")).groupBy("node").agg(*sums)
    each = materialize(each.join(labels.withColumnRenamed("id", "node"), "node", "left").where("component IS NOT NULL OR n > 1"), "paragraph-classes")
    repeats = F.col("n") > 1 if within else F.col("low") < F.col("high")
    linked = each.where("component IS NOT NULL")
    named = linked.groupBy("component").agg(*sums).where(repeats).select("component", "first")
    classes = linked.select("node", "component").join(named, "component").select("node", "component", "first")
    classes = materialize(classes.union(each.where(F.col("component").isNull() & repeats).select("node", F.col("node").alias("component"), "first")), "classes")
    out = found.select(id_col, "key", "begin", "end", "n_words", "node").join(classes, "node")
    out = out.select(
        id_col, "key", "begin", "end", "n_words", "component", F.col("first.id").alias("first_id"), (~where.eqNullSafe(F.col("first"))).alias("removed")
    )
    # A passage that lies in a removal removes nothing more, and a first place in a reported paragraph is no news.
    both = out.withColumn("passage", F.lit(False)).union(passages.withColumn("passage", F.lit(True)))
    before = Window.partitionBy("key").orderBy("begin").rangeBetween(Window.unboundedPreceding, 0)
    reach = lambda which: F.max(F.when(~F.col("passage") & which, F.col("end"))).over(before)
    covered = F.when(F.col("removed"), reach(F.col("removed"))).otherwise(reach(F.lit(True))) >= F.col("end")
    return both.withColumn("covered", F.coalesce(covered, F.lit(False))).where("NOT (passage AND covered)").drop("passage", "covered")


def paragraph_classes(docs: DataFrame) -> DataFrame:
    """The query's rows: the paragraphs that several documents share, with their documents."""
    return repeated_paragraphs(docs, within=False).drop("key")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removals cut from the texts; all columns stay."""
    cuts = (
        repeated_paragraphs(docs, id_col, text_col)
        .where("removed")
        .groupBy(F.col("key").alias("__wf_key"))
        .agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("__wf_cuts"))
    )
    joined = docs.withColumn("__wf_key", row_key(id_col, text_col)).join(cuts, "__wf_key", "left").select(*docs.columns, "__wf_cuts")
    names = docs.columns
    at = names.index(text_col)

    def run(batches):
        for batch in small(batches):
            new = []
            for data, spans in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if data and spans:
                    out, last = [], 0
                    for s in spans:
                        if s["end"] > last:
                            out.append(data[last : max(last, s["begin"])])
                            last = s["end"]
                    data = b"".join(out) + data[last:]
                new.append(data)
            kind = batch.schema.field(at)
            yield batch.set_column(at, kind, pa.array(new, pa.binary()).cast(kind.type)).select(names)

    return joined.mapInArrow(run, docs.schema)
