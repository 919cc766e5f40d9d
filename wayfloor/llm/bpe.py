"""Byte-level BPE encoding and decoding (operator 6).

Texts are cut into chunks that overlap.  Each chunk is pre-tokenised by
itself, so the chunks of one long text are dealt to many tasks.  Where two
neighbours have a pre-token boundary in common inside their overlap, the later
chunk is in step with the earlier one from there on; these points cut the text
into pieces, which are dealt to tasks again, and each piece is encoded as if it
stood alone.  Decoding concatenates the raw bytes of the ids.

Why the ids are right: the first chunk is in step with the whole text.  A match
depends only on where it begins and on what follows, so a chunk that shares a
boundary with a neighbour in step is in step from there on.  A chunk without a
common point is pre-tokenised again from the last boundary in step, until a
boundary is one of a chunk's own; a piece is longer than a chunk or two only
where one match of the pattern is.  Cut points come after a
character that is no white space: look-ahead for white space, the only context
the pattern uses, then sees the same on both sides.

Defined cases: null text is empty and has no tokens; repeated rows are encoded
each; texts shorter than a chunk are one piece and are not shuffled.  Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.llm.common import materialize, process_cache, row_key, small

#: Characters of a chunk, and by how many it reaches into the next one.
CHUNK_CHARS, OVERLAP_CHARS = 1 << 16, 1 << 9


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path: str, pattern: str):
    """The tiktoken encoding of a rank file, one per process."""
    import tiktoken

    key = ("bpe", path, pattern)
    if key not in process_cache():
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        process_cache()[key] = tiktoken.Encoding("wayfloor", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return process_cache()[key]


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def boundaries(text: str, pattern: str) -> np.ndarray:
    """Ends of the pre-tokens that follow a character other than white space."""
    import regex

    ends = [m.end() for m in regex.finditer(pattern, text)]
    return np.array([e for e in ends if not text[e - 1].isspace()], dtype=np.int64)


def encode(
    docs: DataFrame,
    path: str | None = None,
    pattern: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """Pieces in order: ``(doc_key, id, piece, last_piece, ids array<int>)``.

    ``piece`` numbers the pieces of a document from 0, ``last_piece`` is the last
    number.  ``doc_key`` tells rows with the same id apart, unless they repeat
    whole.
    """
    path, pattern = path or tokenizer_path(), pattern or tokenizer_pattern()
    short, long = _split(docs, pattern, id_col, text_col, chunk_chars, overlap_chars)
    return _encode_pieces(short, id_col, path, pattern).unionByName(_encode_pieces(long, id_col, path, pattern))


def _split(docs, pattern, id_col="doc_id", text_col="text", chunk_chars=CHUNK_CHARS, overlap_chars=OVERLAP_CHARS) -> tuple[DataFrame, DataFrame]:
    """Pieces of the texts that fit in a chunk, which are the texts themselves, and of the longer ones."""
    rows = docs.select(
        row_key(id_col, text_col).alias("doc_key"), F.col(id_col).alias(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")
    )
    none = F.lit(0).cast("long")
    short = rows.where(F.length("t") <= chunk_chars).select("doc_key", id_col, none.alias("piece"), none.alias("last_piece"), "t")
    return short, _pieces(rows.where(F.length("t") > chunk_chars), id_col, pattern, chunk_chars, overlap_chars)


def _inner(part: str, pattern: str, whole: bool) -> np.ndarray:
    """Boundaries of a text; where it goes on (not ``whole``), its last match may have been cut short."""
    found = boundaries(part, pattern)
    return found if whole or not len(found) else found[:-1]


def _pieces(long: DataFrame, id_col: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Texts cut at the points where the chunks resynchronise."""
    id_type = long.schema[id_col].dataType.simpleString()

    def cut(batches):
        for batch in small(batches, 16):
            rows, ks, lasts, parts = [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                starts = range(0, len(t), chunk)
                rows += [i] * len(starts)
                ks += range(len(starts))
                lasts += [len(starts) - 1] * len(starts)
                parts += [t[at : at + chunk + overlap] for at in starts]
            take = pa.array(rows, pa.int64())
            kept = [batch.column(c).take(take) for c in range(2)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ks, pa.int64()), pa.array(lasts, pa.int64()), pa.array(parts, pa.string())], names=["doc_key", id_col, "k", "last", "part"])

    chunks = long.select("doc_key", id_col, "t").mapInArrow(cut, f"doc_key long, `{id_col}` {id_type}, k long, last long, part string")
    # Whole repeated rows share a key: they are encoded once and counted.
    chunks = materialize(chunks.groupBy("doc_key", "k").agg(F.first(id_col).alias(id_col), F.first("last").alias("last"), F.first("part").alias("part"), F.count(F.lit(1)).alias("copies")), "chunks")

    def bounds(batches):
        many = pa.list_(pa.int64())
        for batch in small(batches, 16):
            heads, tails, ends = [], [], []
            for k, last, part in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                b = _inner(part, pattern, k == last or len(part) < chunk + overlap)
                heads.append(b[b < min(overlap, chunk)].tolist())
                tails.append((b[(b >= chunk) & (b < 2 * chunk)] - chunk).tolist())
                ends.append(int(b[-1]) if len(b) else 0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(3)), pa.array(heads, many), pa.array(tails, many), pa.array(ends, pa.int64())], names=["doc_key", "k", "last", "heads", "tails", "end"]
            )

    found = chunks.select("doc_key", "k", "last", "part").mapInArrow(bounds, "doc_key long, k long, last long, heads array<long>, tails array<long>, end long")
    found = materialize(found, "bounds")
    before = found.select("doc_key", (F.col("k") + 1).alias("k"), F.col("tails").alias("before"), F.col("end").alias("anchor"))
    cuts = found.join(before, ["doc_key", "k"], "left").select("doc_key", "k", "last", F.array_min(F.array_intersect("before", "heads")).alias("cut"), "anchor")
    cuts = _repaired(materialize(cuts, "cuts"), chunks, pattern, chunk, overlap)

    upto = Window.partitionBy("doc_key").orderBy("k")
    numbered = cuts.select("doc_key", "k", "cut", F.count("cut").over(upto).alias("piece"), F.count("cut").over(Window.partitionBy("doc_key")).alias("last_piece"))
    own = F.substring("part", 1, chunk)
    begin = F.coalesce("cut", F.lit(0)).cast("int")
    sides = F.array(
        F.struct(F.when(F.col("cut") > 0, F.col("piece") - 1).alias("piece"), F.substring(own, F.lit(1), begin).alias("text")),
        F.struct(F.col("piece").alias("piece"), F.substring(own, begin + 1, F.lit(chunk)).alias("text")),
    )
    segments = chunks.join(numbered, ["doc_key", "k"]).select("doc_key", id_col, "copies", "last_piece", "k", F.explode(sides).alias("s")).where("s.piece IS NOT NULL")
    segments = segments.select("doc_key", id_col, "copies", "last_piece", "s.piece", F.struct("k", F.col("s.text").alias("text")).alias("segment"))
    pieces = segments.groupBy("doc_key", "piece").agg(
        F.first(id_col).alias(id_col), F.first("copies").alias("copies"), F.first("last_piece").alias("last_piece"), F.sort_array(F.collect_list("segment")).alias("segments")
    )
    joined = F.array_join(F.transform("segments", lambda x: x["text"]), "").alias("t")
    return pieces.select("doc_key", id_col, "piece", "last_piece", joined, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("col")


def _repaired(cuts: DataFrame, chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """``cuts(doc_key, k, last, cut, anchor)`` with every chunk joined in step to the one before.

    A chunk without a common point is pre-tokenised again from the last boundary
    of the chunk before (``anchor``), together with what follows it, until a
    boundary is one of a chunk's own; the chunks passed by then are cut at the
    boundaries found.  All such places of all texts are done in the same round;
    those that are not in step by then look twice as far in the next one, so
    rounds grow with the logarithm of the longest stretch out of step.
    """
    waiting, reach = None, 1
    while True:
        # The first of every run of chunks out of step; an anchor moves on with the boundaries that a round found.
        follows = F.coalesce(F.lag("cut").over(Window.partitionBy("doc_key").orderBy("k")).isNull() & (F.col("k") > 1), F.lit(False))
        todo = cuts.withColumn("follows", follows).where(F.col("cut").isNull() & (F.col("k") > 0) & ~F.col("follows")).select("doc_key", "k", "last", (F.col("k") - 1).alias("a"), F.coalesce("anchor", F.lit(0)).alias("p"))
        if waiting is not None:
            todo = waiting.unionByName(todo.join(waiting.select("doc_key").distinct(), "doc_key", "left_anti"))
        todo = materialize(todo, "out-of-step")
        if not todo.limit(1).count():
            return cuts.select("doc_key", "k", F.when(F.col("cut") >= 0, F.col("cut")).alias("cut"))
        reach *= 2
        upto = F.least(F.col("k") + reach - 1, "last")
        parts = todo.select("*", F.explode(F.sequence("a", upto)).alias("at")).join(chunks.select("doc_key", F.col("k").alias("at"), "part"), ["doc_key", "at"])
        texts = parts.groupBy("doc_key", "k", "last", "a", "p").agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))

        def repair(batches):
            for batch in small(batches, 4):
                out = []
                for key, k, last, a, p, found in zip(*(c.to_pylist() for c in batch.columns)):
                    n = found[-1]["at"]
                    text = "".join(x["part"][:chunk] for x in found[:-1]) + found[-1]["part"]
                    new = _inner(text[p:], pattern, n == last or len(found[-1]["part"]) < chunk + overlap) + p
                    synced = False
                    for x in found:
                        if x["at"] < k:
                            continue
                        zero = (x["at"] - a) * chunk
                        here = new[(new >= zero) & (new < zero + chunk)] - zero
                        own = _inner(x["part"], pattern, x["at"] == last or len(x["part"]) < chunk + overlap)
                        both = np.intersect1d(here, own)
                        synced = len(both) > 0
                        # -1: no boundary in the whole chunk, which is settled all the same.
                        out.append((key, x["at"], int(both[0]) if synced else int(here[0]) if len(here) else -1, None, None))
                        if synced:
                            break
                    if not synced and n < last:
                        end = int(new[new < (n + 1 - a) * chunk].max(initial=p))
                        out.append((key, n + 1, None, a + end // chunk, end % chunk))
                kinds = [pa.int64()] * 5
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["doc_key", "k", "new", "a", "p"])

        done = materialize(texts.select("doc_key", "k", "last", "a", "p", "parts").mapInArrow(repair, "doc_key long, k long, new long, a long, p long"), "repaired")
        told = cuts.join(done.select("doc_key", "k", "new", F.col("a").isNotNull().alias("again")), ["doc_key", "k"], "left")
        lasts = cuts.select("doc_key", "k", "last")
        waiting = materialize(done.where("a IS NOT NULL").select("doc_key", "k", "a", "p").join(lasts, ["doc_key", "k"]).select("doc_key", "k", "last", "a", "p"), "waiting")
        # A chunk behind one that is cut anew is out of step until it is looked at.
        fresh = F.when(F.coalesce("again", F.lit(False)), F.lit(None)).otherwise(F.coalesce("new", "cut"))
        cuts = materialize(told.select("doc_key", "k", "last", fresh.alias("cut"), "anchor"), "cuts")


def _encode_pieces(pieces: DataFrame, id_col: str, path: str, pattern: str) -> DataFrame:
    id_type = pieces.schema[id_col].dataType.simpleString()

    def run(batches):
        enc, none = encoder(path, pattern), np.zeros(0, np.int32)
        for batch in small(batches):
            ids = [enc.encode_to_numpy(t, disallowed_special=()).view(np.int32) if t else none for t in batch.column(4).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([none, *ids])))], names=["doc_key", id_col, "piece", "last_piece", "ids"]
            )

    return pieces.mapInArrow(run, f"doc_key long, `{id_col}` {id_type}, piece long, last_piece long, ids array<int>")


def decode(pieces: DataFrame, path: str | None = None, pattern: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``pieces`` with a binary column ``data``: the raw bytes of the ids, which may end inside a character."""
    path, pattern = path or tokenizer_path(), pattern or tokenizer_pattern()

    @F.pandas_udf("binary")
    def raw(ids):
        enc = encoder(path, pattern)
        return ids.map(lambda x: b"" if x is None else enc.decode_bytes(x.tolist()))

    return pieces.withColumn("data", raw(ids_col))


def token_digest(docs: DataFrame, path: str | None = None, pattern: str | None = None, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both digests stream over the pieces of a document.

    Documents of one piece are digested where they are encoded; the pieces of
    longer ones are brought together by key and hashed in order, one at a time.
    """
    path, pattern = path or tokenizer_path(), pattern or tokenizer_pattern()
    short, long = (_encode_pieces(x, "doc_id", path, pattern) for x in _split(docs, pattern, **options))
    id_type = short.schema["doc_id"].dataType.simpleString()

    def run(batches):
        enc = encoder(path, pattern)
        ids_hash = data_hash = n = None
        for batch in small(batches):
            rows, column = {"doc_id": [], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}, batch.column(4)
            flat, ends = column.values.to_numpy(), column.offsets.to_numpy()
            for i, (key, piece, last) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                ids = flat[ends[i] : ends[i + 1]]
                if piece == 0:
                    ids_hash, data_hash, n = hashlib.sha256(), hashlib.sha256(), 0
                ids_hash.update(ids.astype("<u4").tobytes())
                data_hash.update(enc.decode_bytes(ids.tolist()))
                n += len(ids)
                if piece == last:
                    for name, value in zip(rows, (key, n, ids_hash.hexdigest(), data_hash.hexdigest())):
                        rows[name].append(value)
            kinds = (batch.schema.field(1).type, pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], names=list(rows))

    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    # A repeated row has its pieces more than once: number the copies, so that each is hashed by itself.
    long = long.withColumn("__copy", F.row_number().over(Window.partitionBy("doc_key", "piece").orderBy("last_piece")))
    long = long.repartition("doc_key").sortWithinPartitions("doc_key", "__copy", "piece").select("doc_key", "doc_id", "piece", "last_piece", "ids")
    return short.mapInArrow(run, schema).unionByName(long.mapInArrow(run, schema))
