"""Exact substring deduplication by a Burrows-Wheeler transform (operator 3).

A byte is removed if some string of ``MIN_BYTES`` bytes that covers it also
starts anywhere else.  The work is cut so that equal strings meet in one place:

1. In every text, each window of ``MIN_BYTES`` bytes has an anchor, its least
   hash of ``GRAM`` bytes.  Equal windows have equal anchors, at the same place
   inside.  Runs of windows with one anchor are one row: the anchor's
   fingerprint and a hash of the run's bytes.
2. Runs whose fingerprint occurs once share no window with anything.  Runs that
   are equal as a whole repeat as a whole.
3. What is left, runs with one fingerprint and different bytes, is compared by
   suffixes: a batch of such runs is one text, whose suffixes are sorted to the
   ends of the runs and transformed.  The order alone does not say how much
   neighbours share; breadth-first backward extension splits the intervals of
   the transform at common prefixes of increasing length, and stops at
   ``MIN_BYTES``: suffixes not split by then share that much.
4. A fingerprint with more bytes than a batch holds is not compared in one
   task: its runs are anchored anew by another hash, so that they part into
   shorter runs under more fingerprints, and steps 2 and 3 follow for these.
   What is still as large after ``LEVELS`` such hashes is one passage in ever
   other surroundings; the hashes of its windows are counted, with partial sums.

Defined cases: null text is empty; texts shorter than ``MIN_BYTES`` are kept
whole; a repeated row is a second place, so both rows lose what they share,
which is everything; matches may overlap.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.llm.common import materialize, process_cache, row_key, small
from wayfloor.llm.shingles import mix

MIN_BYTES, GRAM = 200, 64
_WINDOW = MIN_BYTES - GRAM + 1
#: Windows of a text handled at once.
_CHUNK = 1 << 19
#: Bytes of a batch that is sorted, and of one fingerprint's runs beyond which these are anchored anew, so often at most.
BATCH_BYTES, HOT_BYTES, LEVELS = 800_000, 1_000_000, 3


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of every ``GRAM`` bytes, by doubling."""
    cache = process_cache()
    if "substring_bytes" not in cache:
        cache["substring_bytes"] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h, size = cache["substring_bytes"][raw], 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0xD1342543DE82EF95 + 2 * size) + h[size:]
        size *= 2
    return mix(h)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row, by doubling."""
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchored_runs(data: bytes) -> list[tuple[int, int, int, int]]:
    """(fingerprint, hash of the run's bytes, first window, last window) of the runs of windows with one anchor."""
    out = []
    for at in range(0, len(data) - MIN_BYTES + 1, _CHUNK):
        part = data[at : at + _CHUNK + MIN_BYTES - 1]
        h = _gram_hashes(np.frombuffer(part, np.uint8))
        place = np.uint64((1 << 20) - 1)
        anchor = (_least((h & ~place) | np.arange(len(h), dtype=np.uint64), _WINDOW) & place).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.concatenate((first[1:], [len(anchor)])) - 1
        names = h[anchor[first]].view(np.int64).tolist()
        out += [(fp, xxhash.xxh3_64_intdigest(part[a : b + MIN_BYTES]), at + a, at + b) for fp, a, b in zip(names, first.tolist(), last.tolist())]
    return out


def _runs(docs: DataFrame) -> DataFrame:
    """``(uid, t)`` -> ``(uid, fp, ctx, a, b, n)``: n counts equal runs of one text; their places have rows without fp."""

    def run(batches):
        for batch in small(batches):
            rows = []
            for uid, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if not data or len(data) < MIN_BYTES:
                    continue
                seen: dict[tuple[int, int], list] = {}
                for fp, ctx, a, b in anchored_runs(data):
                    seen.setdefault((fp, ctx), []).append((a, b))
                for (fp, ctx), places in seen.items():
                    rows.append((uid, fp, ctx - (1 << 63), *places[0], len(places)))
                    if len(places) > 1:
                        rows += [(uid, None, None, a, b, 0) for a, b in places]
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["uid", "fp", "ctx", "a", "b", "n"])

    return docs.mapInArrow(run, "uid long, fp long, ctx long, a long, b long, n long")


def sorted_suffixes(text: np.ndarray, symbols: int, depth: int) -> np.ndarray:
    """Positions of ``text`` (small integers, padded here with 0) in order of the next ``depth`` symbols."""
    n, bits = len(text), max(1, int(symbols - 1).bit_length())
    padded = np.concatenate((text.astype(np.int64), np.zeros(depth + 63, np.int64)))
    length = min(63 // bits, depth)
    key = np.zeros(n, np.int64)
    for k in range(length):
        key = key << bits | padded[k : k + n]
    while True:
        order = np.argsort(key)
        if length == depth:
            return order
        ordered = key[order]
        rank = np.zeros(n + depth, np.int64)
        rank[order] = 1 + np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        longer = min(3 * length, depth)
        one, two = (longer - length) // 2, longer - length
        key = rank[:n] << 42 | rank[one : one + n] << 21 | rank[two : two + n]
        length = longer


def common_prefix_groups(text: np.ndarray, symbols: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, group of each): a group shares its first ``depth`` symbols, as far as no 0 is among them.

    Breadth-first backward extension on the transform.  ``split`` holds where
    neighbours in suffix order are known to differ.  Each level takes the splits
    that the last one found: two equal symbols of the transform that stand on
    both sides of one, but in one interval before, lead to suffixes that share
    one symbol more, and are split in turn.  Of the parts of an interval the
    largest need not be looked at.  Symbol 0 ends a string and is never extended.
    """
    n = len(text)
    ends = np.flatnonzero(text == 0)
    longest = int(np.diff(np.concatenate(([-1], ends))).max()) if len(ends) else n
    order = sorted_suffixes(text, symbols, max(longest, depth))
    last = text[order - 1]
    column = np.argsort(last, kind="stable")
    to = np.empty(n, np.int64)
    to[column] = np.arange(n)
    same = last[column[1:]] == last[column[:-1]]
    before, after = np.full(n, -1), np.full(n, n)
    before[column[1:][same]] = column[:-1][same]
    after[column[:-1][same]] = column[1:][same]
    ends = last == 0
    before[ends], after[ends] = -1, n

    head = text[order]
    split = np.zeros(n, bool)
    split[0] = True
    new = np.flatnonzero(head[1:] != head[:-1]) + 1
    for _ in range(1, depth):
        if not len(new):
            break
        old = np.flatnonzero(split)
        left = old[np.searchsorted(old, new, side="right") - 1]  # the interval that each new split is in
        nxt = np.searchsorted(old, new, side="right")
        right = np.where(nxt < len(old), old[np.minimum(nxt, len(old) - 1)], n)
        # Parts: one before each new split of an interval, one after its last.
        final = np.concatenate((left[1:] != left[:-1], [True]))
        start = np.concatenate((np.where(np.concatenate(([True], final[:-1])), left, np.concatenate(([0], new[:-1]))), new[final]))
        end = np.concatenate((new, right[final]))
        low, high = np.concatenate((left, left[final])), np.concatenate((right, right[final]))
        size = end - start
        rank = np.lexsort((size, low))
        largest = rank[np.concatenate((low[rank][1:] != low[rank][:-1], [True]))]
        use = np.ones(len(size), bool)
        use[largest] = False
        split[new] = True
        start, end, low, high, size = start[use], end[use], low[use], high[use], size[use]
        at = np.repeat(start - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        start, end, low, high = (np.repeat(v, size) for v in (start, end, low, high))
        p, q = before[at], after[at]
        found = np.concatenate((to[at[(p >= low) & (p < start)]], to[q[(q >= end) & (q < high)]]))
        new = np.unique(found[~split[found]])
    split[new] = True
    return order, np.cumsum(split)


def shared_windows(runs: list[bytes], depth: int = MIN_BYTES) -> list[np.ndarray]:
    """For every run, which of its windows also start in a run elsewhere in the list."""
    raw = np.frombuffer(b"\x00".join(runs) + b"\x00", np.uint8)
    sizes = np.array([len(r) for r in runs])
    stops = np.cumsum(sizes + 1) - 1
    present = np.zeros(256, bool)
    present[raw] = True
    code = np.cumsum(present)  # bytes that occur, from 1
    text = code[raw].astype(np.uint16 if present.sum() > 254 else np.uint8)
    text[stops] = 0
    order, group = common_prefix_groups(text, int(present.sum()) + 1, depth)
    begin = np.concatenate(([0], stops[:-1] + 1))
    room = np.repeat(stops, sizes + 1) - np.arange(len(text))
    fits = room >= depth
    count = np.bincount(group[fits[order]], minlength=int(group[-1]) + 1)
    shared = np.zeros(len(text), bool)
    shared[order] = count[group] > 1
    shared &= fits
    return [shared[b : b + max(0, s - depth + 1)] for b, s in zip(begin.tolist(), sizes.tolist())]


def _ranges(mask: np.ndarray, offset: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return [(offset + a, offset + b - 1 + MIN_BYTES) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]


def _compared(rows: DataFrame) -> DataFrame:
    """``(fp, uid, a, alone, bytes)``, sorted by fp in each partition -> covered ranges ``(uid, begin, end)``."""

    def finish(held):
        out = []
        for (uid, a, alone, _), mask in zip(held, shared_windows([h[3] for h in held])):
            if alone:
                out += [(uid, x, y) for x, y in _ranges(mask, a)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["uid", "begin", "end"])

    def run(batches):
        held, size, fp_now = [], 0, None
        for batch in small(batches):
            for fp, uid, a, alone, data in zip(*(c.to_pylist() for c in batch.columns)):
                if fp != fp_now and size > BATCH_BYTES:
                    yield finish(held)
                    held, size = [], 0
                fp_now = fp
                held.append((uid, a, alone, data))
                size += len(data) + 1
        if held:
            yield finish(held)

    return rows.mapInArrow(run, "uid long, begin long, end long")


def _counted(rows: DataFrame) -> DataFrame:
    """The same for fingerprints of very many bytes: window hashes are counted with partial sums."""

    def run(batches):
        for batch in small(batches):
            out = [[], [], [], []]
            for uid, a, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 4))):
                for j in range(len(data) - MIN_BYTES + 1):
                    h = xxhash.xxh3_128_intdigest(data[j : j + MIN_BYTES])
                    for column, value in zip(out, ((h >> 64) - (1 << 63), (h & (1 << 64) - 1) - (1 << 63), uid, a + j)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["h1", "h2", "uid", "begin"])

    windows = materialize(rows.mapInArrow(run, "h1 long, h2 long, uid long, begin long"), "windows")
    many = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    return windows.join(many, ["h1", "h2"]).select("uid", "begin", (F.col("begin") + MIN_BYTES).alias("end"))


def _anchored_anew(rows: DataFrame, level: int) -> DataFrame:
    """``(fp, uid, a, alone, bytes)`` -> the same of shorter runs, by the least of another hash, with ``ctx`` of the bytes."""
    seed = np.uint64((0xA0761D6478BD642F * (2 * level + 1)) % (1 << 64))

    def run(batches):
        for batch in small(batches):
            out = []
            for fp, uid, a, alone, data in zip(*(c.to_pylist() for c in batch.columns)):
                h = mix(_gram_hashes(np.frombuffer(data, np.uint8)) ^ seed)
                place = np.uint64((1 << 20) - 1)
                anchor = (_least((h & ~place) | np.arange(len(h), dtype=np.uint64), _WINDOW) & place).astype(np.int64)
                first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
                last = np.concatenate((first[1:], [len(anchor)])) - 1
                names = mix(h[anchor[first]] + np.uint64(fp & (1 << 64) - 1)).view(np.int64).tolist()
                for name, x, y in zip(names, first.tolist(), last.tolist()):
                    part = data[x : y + MIN_BYTES]
                    out.append((name, uid, a + x, alone, part, xxhash.xxh3_64_intdigest(part) - (1 << 63)))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["fp", "uid", "a", "alone", "bytes", "ctx"])

    return rows.mapInArrow(run, "fp long, uid long, a long, alone boolean, bytes binary, ctx long")


def _shared_ranges(pieces: DataFrame, level: int = 0) -> DataFrame:
    """``(fp, uid, a, alone, bytes, size)``, distinct bytes of each fingerprint and their size together -> covered ranges of those alone."""
    columns = ["fp", "uid", "a", "alone", "bytes"]
    cold = pieces.where(F.col("size") <= HOT_BYTES).select(columns)
    total = cold.agg(F.sum(F.octet_length("bytes") + 1)).first()[0] or 0
    covered = materialize(_compared(cold.repartition(max(1, -(-int(total) // BATCH_BYTES)), "fp").sortWithinPartitions("fp")), "compared-ranges")
    hot = pieces.where(F.col("size") > HOT_BYTES).select(columns)
    if not hot.limit(1).count():
        return covered
    if level == LEVELS:
        return covered.union(_counted(hot))
    rows = materialize(_anchored_anew(hot, level), "anchored-anew")
    kinds = rows.groupBy("fp", "ctx").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("uid", "a")).alias("one"), F.min("alone").alias("alone"))
    kinds = materialize(kinds.withColumn("alone", F.col("alone") & (F.col("k") == 1)), "contexts")
    whole = rows.where("alone").join(kinds.where("k > 1").select("fp", "ctx"), ["fp", "ctx"], "left_semi")
    covered = covered.union(whole.select("uid", F.col("a").alias("begin"), (F.col("a") + F.octet_length("bytes")).cast("long").alias("end")))
    left = rows.join(kinds.select("fp", "ctx", "one.uid", "one.a", F.col("alone").alias("single")), ["fp", "ctx", "uid", "a"]).select("fp", "uid", "a", F.col("single").alias("alone"), "bytes")
    left = left.dropDuplicates(["fp", "uid", "a"])
    sizes = left.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.max("alone").alias("some"), F.sum(F.octet_length("bytes").cast("long")).alias("size")).where("c > 1 AND some").select("fp", "size")
    return covered.union(_shared_ranges(materialize(left.join(materialize(sizes, "sizes"), "fp"), "pieces"), level + 1))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """``docs(uid, t)`` -> ``(uid, ranges array<struct<begin,end>>, n_removed)`` of the texts that lose bytes; ranges are maximal."""
    runs = materialize(_runs(docs), "runs")
    anchors = runs.where("fp IS NOT NULL")
    often = anchors.groupBy("fp").agg(F.sum("n").alias("k")).where("k > 1").select("fp")
    again = materialize(anchors.join(often, "fp", "left_semi"), "repeated-anchors")
    kinds = materialize(again.groupBy("fp", "ctx").agg(F.sum("n").alias("k"), F.min(F.struct("uid", "a", "b")).alias("one")), "contexts")
    whole = again.join(kinds.where("k > 1").select("fp", "ctx"), ["fp", "ctx"], "left_semi")
    end = (F.col("b") + MIN_BYTES).alias("end")
    covered = runs.where("fp IS NULL").select("uid", F.col("a").alias("begin"), end).union(whole.select("uid", F.col("a").alias("begin"), end))

    # Fingerprints with different runs, some of them single.
    size = F.col("one.b") - F.col("one.a") + MIN_BYTES
    mixed = kinds.groupBy("fp").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("least"), F.sum(size).alias("size")).where("c > 1 AND least = 1")
    parts = materialize(kinds.join(mixed.select("fp", "size"), "fp").select("fp", "one.*", (F.col("k") == 1).alias("alone"), "size"), "mixed")
    if parts.limit(1).count():
        lists = parts.groupBy("uid").agg(F.collect_list(F.struct("fp", "a", "b", "alone", "size")).alias("list"))

        def cut(batches):
            for batch in small(batches):
                out = []
                for uid, data, wanted in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                    out += [(w["fp"], uid, w["a"], w["alone"], data[w["a"] : w["b"] + MIN_BYTES], w["size"]) for w in wanted]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["fp", "uid", "a", "alone", "bytes", "size"])

        texts = docs.join(lists, "uid").select("uid", "t", "list")
        pieces = materialize(texts.mapInArrow(cut, "fp long, uid long, a long, alone boolean, bytes binary, size long"), "pieces")
        covered = covered.union(_shared_ranges(pieces))

    @F.pandas_udf("array<struct<begin:long,end:long>>")
    def united(ranges):
        def one(v):
            a = np.array([(r["begin"], r["end"]) for r in v], np.int64)
            a = a[np.argsort(a[:, 0], kind="stable")]
            reach = np.maximum.accumulate(a[:, 1])
            first = np.concatenate(([True], a[1:, 0] > reach[:-1]))
            last = np.concatenate((first[1:], [True]))
            return [{"begin": int(x), "end": int(y)} for x, y in zip(a[first, 0], reach[last])]

        return ranges.map(one)

    gathered = covered.groupBy("uid").agg(F.collect_list(F.struct("begin", "end")).alias("ranges")).select("uid", united("ranges").alias("ranges"))
    lost = F.aggregate("ranges", F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["begin"])
    return materialize(gathered.withColumn("n_removed", lost), "ranges")


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(id_col, text_col).alias("uid"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    source = _source(docs, "doc_id", "text")
    ranges = repeated_ranges(source)
    facts = docs.select(
        "doc_id", row_key("doc_id", "text").alias("uid"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")
    ).select("doc_id", "uid", F.octet_length("t").cast("long").alias("n_bytes"), F.sha2("t", 256).alias("whole"))
    # Only texts that lose a part are read again.
    n_bytes = facts.select("uid", "n_bytes").dropDuplicates(["uid"])
    part = materialize(ranges.join(n_bytes, "uid").where("n_removed < n_bytes").select("uid", "ranges"), "part")

    def digest(batches):
        for batch in small(batches):
            out = []
            for data, ranges in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                kept, last = hashlib.sha256(), 0
                for r in ranges:
                    kept.update(data[last : r["begin"]])
                    last = r["end"]
                kept.update(data[last:])
                out.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["uid", "cut"])

    cut = source.join(part, "uid").select("uid", "t", "ranges").mapInArrow(digest, "uid long, cut string").dropDuplicates(["uid"])
    return facts.join(ranges.select("uid", "n_removed", F.size("ranges").alias("n_spans")), "uid", "left").join(cut, "uid", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"),
        F.when(F.col("n_removed").isNull(), F.col("whole")).otherwise(F.coalesce("cut", F.sha2(F.lit(""), 256))).alias("kept_sha256"),
    )


def remove_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with what repeats cut out, as bytes in a column ``kept`` (a cut may fall inside a character); the text stays."""
    ranges = repeated_ranges(_source(docs, id_col, text_col)).select(F.col("uid").alias("__wf_uid"), F.col("ranges").alias("__wf_ranges"))
    joined = docs.withColumn("__wf_uid", row_key(id_col, text_col)).join(ranges, "__wf_uid", "left")
    data = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "utf-8")
    state = F.struct(F.encode(F.lit(""), "utf-8").alias("kept"), F.lit(0).cast("long").alias("last"))
    piece = lambda a, b: F.substring(data, (a + 1).cast("int"), (b - a).cast("int"))
    cut = F.aggregate("__wf_ranges", state, lambda s, r: F.struct(F.concat(s["kept"], piece(s["last"], r["begin"])).alias("kept"), r["end"].alias("last")))
    kept = F.when(F.col("__wf_ranges").isNull(), data).otherwise(F.concat(cut["kept"], piece(cut["last"], F.octet_length(data).cast("long"))))
    return joined.select(*docs.columns, kept.alias("kept"))
