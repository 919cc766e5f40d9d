"""Phrase collocations per language (operator 12).

Texts fall into pieces between punctuation marks, and identical pieces are
counted once, with a multiplicity.  N-grams of the distinct pieces, weighted so,
are counted in DuckDB, one hash bucket at a time and out of core: a bucket
streams into a table that may spill, and leaves its frequent n-grams only.

That happens twice.  First words and pairs are counted by hash (a few bytes
each; collisions only add to a count, so that no frequent pair is lost), which
gives a bitmap of fixed size.  Then the n-grams all of whose pairs are in the
bitmap are counted by their words, which is exact: what is frequent has frequent
pairs.  Where a corpus fills the bitmap, more is counted and nothing is lost.

A candidate asks for the counts of its parts by rows that are shuffled to them
and aggregated back; common words, which many candidates ask for, are dealt over
salts.  A task adds up what it sees of an n-gram before the shuffle, so a common
phrase is a row a task.

DuckDB spills into a folder of the task, which ends with it, as Spark's own
shuffles do; tables that other tasks read are in the shared folder.

Defined cases: null text is empty, null lang is ``und``; texts without words add
nothing; repeated rows count each; pieces of any length are whole.  An empty
table has no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re
import tempfile
from collections import Counter
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.llm.common import discard, materialize, small

LEAST, LONGEST, TOP, COVERED = 30, 4, 2000, 80
SCORE_SCALE = 2_000_000
#: What ends a piece, and what stands between words.
_CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + b".,;:!?\x0b\x0c\x0d" + b"\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Bits of the bitmap of frequent words and pairs: 8 MB.
BITMAP_BITS = 1 << 26
#: Words that a task looks at together, pieces that it counts together, least number of buckets, and words of a bucket, about.
FLUSH_WORDS, FLUSH_PIECES, LEAST_BUCKETS, BUCKET_WORDS = 1 << 20, 300_000, 1024, 1 << 20
DUCKDB_MEMORY = "256MB"
#: Over so many rows the requests for one word are dealt.
WORD_SALTS = 16


def clean_pieces(texts: list[bytes]) -> list[bytes]:
    """The pieces of UTF-8 texts, lower case in A-Z, with one space between words; some may be empty."""
    joined = b"\n".join(texts).translate(_CLEAN)
    if b"  " in joined:
        joined = re.sub(rb" {2,}", b" ", joined)
    return joined.replace(b" \n", b"\n").replace(b"\n ", b"\n").strip(b" ").split(b"\n")


def distinct_pieces(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``(lang, piece, words, n)``: the distinct pieces of a language, their number of words and of occurrences."""

    def flushed(found):
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k for k, _ in keys], pa.string()),
                pa.array([p for _, p in keys], pa.binary()).cast(pa.string()),
                pa.array([p.count(b" ") + 1 for _, p in keys], pa.int64()),
                pa.array(list(found.values()), pa.int64()),
            ],
            names=["lang", "piece", "words", "n"],
        )

    def run(batches):
        found: Counter = Counter()
        for batch in small(batches, 1024):
            texts: dict = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, of_lang in texts.items():
                for piece, n in Counter(clean_pieces(of_lang)).items():
                    if piece:
                        found[lang, piece] += n
            if len(found) > FLUSH_PIECES:
                yield from flushed(found)
                found = Counter()
        if found:
            yield from flushed(found)

    rows = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.col(text_col).cast("string"))
    pieces = rows.mapInArrow(run, "lang string, piece string, words long, n long")
    return pieces.groupBy("lang", "piece").agg(F.first("words").alias("words"), F.sum("n").alias("n"))


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values stirred so that all bits depend on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words:
    """The words of some pieces: where they begin, which ones they are, and what weighs them."""

    def __init__(self, langs: list[str], pieces: list[bytes], n: np.ndarray):
        import xxhash

        self.text = b"\n".join(pieces) + b"\n"
        codes = np.frombuffer(self.text, np.uint8)
        ends = np.flatnonzero((codes == 32) | (codes == 10))
        self.begins = np.concatenate(([0], ends + 1))
        last = codes[ends] == 10  # of its piece
        self.follows = ~last[:-1]  # the next word is in the same piece
        piece = np.cumsum(last) - last
        self.n = n[piece]
        self.langs, lang = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
        self.lang = lang[piece]
        data = pa.py_buffer(self.text.replace(b"\n", b" "))
        coded = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(self.begins.astype(np.int32)), data]).dictionary_encode()
        self.ids, self.size = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        self.lang_hashes = np.array([xxhash.xxh3_64_intdigest(k.encode(), 1) for k in self.langs], np.uint64)

    def word_keys(self, word: np.ndarray) -> np.ndarray:
        """Keys of (language, word) groups."""
        return _mixed(self.hashes[word % self.size] + self.lang_hashes[word // self.size])

    def pair_keys(self, at: np.ndarray) -> np.ndarray:
        return _mixed(self.hashes[self.ids[at]] * np.uint64(0x9E3779B97F4A7C15) + _mixed(self.hashes[self.ids[at + 1]]) + self.lang_hashes[self.lang[at]])


def _flushes(batches):
    """The pieces of batches ``(lang, piece, n)`` as word tables of about FLUSH_WORDS words."""
    langs, pieces, n, size = [], [], [], 0
    for batch in small(batches, 4096):
        langs += batch.column(0).to_pylist()
        pieces += batch.column(1).cast(pa.binary()).to_pylist()
        n.append(batch.column(2).to_numpy())
        size += batch.column(1).nbytes
        if size > 6 * FLUSH_WORDS:
            yield _Words(langs, pieces, np.concatenate(n))
            langs, pieces, n, size = [], [], [], 0
    if pieces:
        yield _Words(langs, pieces, np.concatenate(n))


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys in order, place of the first of each, its number for every key, sums of weights)."""
    found, first, number = np.unique(keys, return_index=True, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, number, weights)
    return found, first, number, total


def _slots(bucket, key) -> np.ndarray:
    """The bit of the bitmap that stands for a key of a bucket."""
    return _mixed((np.asarray(bucket).astype(np.uint64) << np.uint64(32)) | np.asarray(key).astype(np.uint64)) & np.uint64(BITMAP_BITS - 1)


def _bucket_and_rest(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)


class _Counter:
    """A table of one bucket in DuckDB, which spills what does not fit in its memory."""

    def __init__(self, columns: str):
        import duckdb

        self.folder = tempfile.TemporaryDirectory(prefix="wayfloor-bucket-")
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": DUCKDB_MEMORY, "temp_directory": self.folder.name, "preserve_insertion_order": False})
        self.columns, self.held, self.rows = columns, [], 0
        self.con.execute(f"CREATE TABLE t ({columns})")

    def add(self, rows: pa.Table):
        self.held.append(rows)
        self.rows += rows.num_rows
        if self.rows > 1 << 19:
            self.insert()

    def insert(self):
        if self.held:
            self.con.register("held", pa.concat_tables(self.held))
            self.con.execute("INSERT INTO t SELECT * FROM held")
            self.con.unregister("held")
        self.held, self.rows = [], 0

    def result(self, query: str) -> pa.Table:
        """The rows of a query over what was added; the table is empty afterwards."""
        self.insert()
        found = self.con.sql(query).to_arrow_table()
        self.con.execute(f"DROP TABLE t; CREATE TABLE t ({self.columns})")
        return found

    def close(self):
        self.con.close()
        self.folder.cleanup()


def _per_bucket(batches, columns: str, read, query: str):
    """(bucket, result of the query over its rows) of batches sorted by their first column."""
    counter, last = _Counter(columns), None
    try:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in pairwise(cuts):
                if a == b:
                    continue
                if last is not None and ids[a] != last:
                    yield last, counter.result(query)
                last = int(ids[a])
                counter.add(read(batch.slice(a, b - a)))
        if last is not None:
            yield last, counter.result(query)
    finally:
        counter.close()


def _frequent_bitmap(pieces: DataFrame, buckets: int, least: int) -> np.ndarray:
    """Bits of the words and pairs whose hashes occur ``least`` times or more."""
    weight = np.uint8 if least < 256 else np.uint32

    def emit(batches):
        for w in _flushes(batches):
            words, _, _, n_words = _sums(w.lang * w.size + w.ids, w.n)
            at = np.flatnonzero(w.follows)
            keys, _, _, n = _sums(np.concatenate([w.word_keys(words), w.pair_keys(at)]), np.concatenate([n_words, w.n[at]]))
            bucket, rest = _bucket_and_rest(keys, buckets)
            rest, n = rest.astype(np.uint32), np.minimum(n, least).astype(weight)
            cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
            spans = [(a, b) for a, b in pairwise(cuts) if b > a]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
                    pa.array([rest[a:b].tobytes() for a, b in spans], pa.binary()),
                    pa.array([n[a:b].tobytes() for a, b in spans], pa.binary()),
                ],
                names=["bucket", "keys", "n"],
            )

    def read(rows):
        joined = [b"".join(rows.column(c).to_pylist()) for c in (1, 2)]
        return pa.table({"k": np.frombuffer(joined[0], np.uint32), "n": np.frombuffer(joined[1], weight)})

    def count(batches):
        for bucket, found in _per_bucket(small(batches, 4096), "k UINTEGER, n UINTEGER", read, f"SELECT k FROM t GROUP BY k HAVING sum(n) >= {least}"):
            bits = _slots(bucket, found.column(0).to_numpy())
            slot, value = (bits >> np.uint64(6)).astype(np.int64), (np.uint64(1) << (bits & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(value)], names=["slot", "bits"])

    blobs = pieces.select("lang", "piece", "n").mapInArrow(emit, "bucket int, keys binary, n binary")
    found = blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "slot long, bits long")
    rows = found.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP_BITS >> 6, np.int64)
    bitmap[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy()
    return bitmap.view(np.uint64)


def phrase_counts(pieces: DataFrame, buckets: int, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``(lang, words, phrase, f)`` of all n-grams of 1 to ``longest`` words that occur ``least`` times or more."""
    bitmap = pieces.sparkSession.sparkContext.broadcast(_frequent_bitmap(pieces, buckets, least))

    def frequent(keys):
        bits = _slots(*_bucket_and_rest(keys, buckets))
        return (bitmap.value[(bits >> np.uint64(6)).astype(np.int64)] >> (bits & np.uint64(63))) & np.uint64(1) == 1

    def emit(batches):
        for w in _flushes(batches):
            words, first, number, total = _sums(w.lang * w.size + w.ids, w.n)
            common = frequent(w.word_keys(words))
            found = [(1, first[common], total[common])]
            at = np.flatnonzero(w.follows & common[number[:-1]] & common[number[1:]])
            at = at[frequent(w.pair_keys(at))]
            follows = np.zeros(len(w.ids) + 1, bool)  # a frequent pair begins here
            follows[at] = True
            group, known = number[at], at
            for k in range(2, longest + 1):
                # The group of the first k - 1 words and the next word: exact, since both are numbers of this flush.
                keys, first, number, total = _sums(group * w.size + w.ids[at + k - 1], w.n[at])
                found.append((k, at[first], total))
                keep = follows[at + k - 1] if k < longest else np.zeros(len(at), bool)
                at, group = at[keep], number[keep]
            for k, begins, n in found:
                if not len(n):
                    continue
                a, b = w.begins[begins].tolist(), (w.begins[begins + k] - 1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(w.langs[w.lang[begins]].tolist(), pa.string()),
                        pa.array(np.full(len(n), k, np.int32)),
                        pa.array([w.text[x:y] for x, y in zip(a, b)], pa.binary()).cast(pa.string()),
                        pa.array(n),
                    ],
                    names=["lang", "words", "phrase", "n"],
                )

    def count(batches):
        columns = ["lang", "words", "phrase", "n"]
        read = lambda rows: pa.Table.from_batches([rows]).select(columns)
        query = f"SELECT lang, words, phrase, CAST(sum(n) AS BIGINT) AS f FROM t GROUP BY ALL HAVING sum(n) >= {least}"
        for _, found in _per_bucket(batches, "lang VARCHAR, words INTEGER, phrase VARCHAR, n BIGINT", read, query):
            kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            for batch in found.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(batch.columns, kinds)], names=["lang", "words", "phrase", "f"])

    grams = pieces.select("lang", "piece", "n").mapInArrow(emit, "lang string, words int, phrase string, n long")
    grams = grams.select(F.pmod(F.xxhash64("lang", "phrase"), F.lit(buckets)).cast("int").alias("bucket"), "lang", "words", "phrase", "n")
    return grams.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "lang string, words int, phrase string, f long")


def scored(counts: DataFrame) -> DataFrame:
    """``(lang, phrase, words, a, l, r, score)`` of the phrases of two words or more, by their lowest-scoring cut."""
    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")
    cuts = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), cut)
    side = lambda number, part, words: F.struct(F.lit(number).alias("side"), part.alias("part"), words.alias("part_words"))
    parts = F.split("phrase", " ")
    sides = F.array(
        side(0, F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " "), F.col("cut")),
        side(1, F.array_join(F.slice(parts, F.col("cut") + 1, F.col("words") - F.col("cut")), " "), F.col("words") - F.col("cut")),
    )
    requests = cuts.select("*", F.explode(sides).alias("s")).select("lang", "phrase", "words", "a", "cut", "s.*")
    salt = F.when(F.col("part_words") == 1, F.pmod(F.xxhash64("phrase"), F.lit(WORD_SALTS))).otherwise(F.lit(0).cast("long"))
    salts = F.when(F.col("words") == 1, F.sequence(F.lit(0).cast("long"), F.lit(WORD_SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    replies = counts.select("lang", F.col("phrase").alias("part"), "f", F.explode(salts).alias("salt"))
    told = requests.withColumn("salt", salt).join(replies.hint("merge"), ["lang", "part", "salt"])
    at = lambda number: F.max(F.when(F.col("side") == number, F.col("f")))
    whole = told.groupBy("lang", "phrase", "words", "a", "cut").agg(at(0).alias("l"), at(1).alias("r"))
    score = F.expr(f"CAST((CAST(a AS DECIMAL(19,0)) * {SCORE_SCALE}) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0))) AS LONG)")
    best = whole.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "words", "a", "best.l", "best.r", "best.score")


def covered(counts: DataFrame, percent: int = COVERED) -> DataFrame:
    """``(lang, phrase)`` of the phrases that a longer one holds in so many percent of their occurrences."""
    longer = counts.where("words > 2").select("lang", F.split("phrase", " ").alias("w"), "words", "f")
    lengths = longer.select("*", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("k"))
    inside = lengths.select("lang", "f", "w", "k", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("k") + 1)).alias("i"))
    most = inside.groupBy("lang", F.array_join(F.slice("w", F.col("i"), F.col("k")), " ").alias("phrase")).agg(F.max("f").alias("most"))
    both = most.join(counts.where("words > 1"), ["lang", "phrase"])
    return both.where(F.col("most").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * percent).select("lang", "phrase")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, percent: int = COVERED, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of every language."""
    pieces = materialize(distinct_pieces(docs, lang_col, text_col), "pieces")
    totals = materialize(pieces.groupBy("lang").agg(F.sum(F.col("words") * F.col("n")).alias("n")), "totals")
    words = pieces.agg(F.coalesce(F.sum("words"), F.lit(0))).head()[0]
    counts = materialize(phrase_counts(pieces, max(LEAST_BUCKETS, words // BUCKET_WORDS), least, longest), "phrase-counts")
    discard(pieces)
    found = scored(counts).join(covered(counts, percent), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
