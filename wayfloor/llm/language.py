"""Language identification with rank-order n-gram profiles (operator 1).

The most frequent n-grams (n = 1 to 3, inside words padded with a boundary) of
each language are its profile.  A document's own most frequent n-grams are
compared to every profile by out-of-place distance: the sum over its n-grams of
the difference of ranks, with the profile length for a missing one.  The
nearest language wins, ties by name.

Profiles are learned from at most ``MAX_DOCS_PER_LANGUAGE`` labelled documents
of each language (in expectation), chosen by a hash of the id; prediction sees
only the text, and the whole of it.

Defined cases: null text and text without a letter is ``und`` with score 0, and
so is everything when nothing is learned; a null label is not learned from;
repeated rows are predicted alike.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfloor.llm.common import process_cache, shared_model, small

#: Length of a profile, longest n-gram, and the bound of the learning sample.
PROFILE, MAX_N, MAX_DOCS_PER_LANGUAGE = 400, 3, 20_000
UNKNOWN = "und"
#: Least score of a text that counts as written in its nearest language; prose scores 0.43 and more, another script or random letters under 0.2.
MIN_SCORE = 0.3
_CHUNK = 1 << 17


def _letters() -> np.ndarray:
    cache = process_cache()
    if "letters" not in cache:
        cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return cache["letters"]


def padded_words(text: str) -> np.ndarray:
    """Lower-cased letters as numbers from 2 on, words divided by a single 1; empty if there is no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    out = np.ones(int(keep.sum()) + 2, np.int64)
    out[1:-1] = np.where(letter, codes + 2, 1)[keep]
    if out[-2] == 1:
        out = out[:-1]
    return out


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed 21 bits a character, and their counts."""
    s = padded_words(text)
    parts = []
    for at in range(0, len(s), _CHUNK):
        x = s[at : at + _CHUNK + MAX_N - 1]  # the n-grams that start in the chunk
        inner = x > 1
        one = x[:_CHUNK][inner[:_CHUNK]]
        two = (x[:-1] << 21 | x[1:])[:_CHUNK]
        three = ((x[:-2] << 42) | (x[1:-1] << 21) | x[2:])[:_CHUNK][inner[1:-1][:_CHUNK]]
        parts.append(np.unique(np.concatenate((one, two, three)), return_counts=True))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    return merged(parts)


def merged(parts) -> tuple[np.ndarray, np.ndarray]:
    grams = np.concatenate([p[0] for p in parts])
    values, back = np.unique(grams, return_inverse=True)
    return values, np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(values)).astype(np.int64)


def top_ranked(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent n-grams in order, ties by n-gram."""
    if len(grams) > 4 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        at = np.flatnonzero(counts >= least)
        grams, counts = grams[at], counts[at]
    return grams[np.argsort(-counts, kind="stable")[:k]]


class Profiles:
    """Ranks of n-grams in every language: ``ranks[i, j]`` for ``grams[i]`` and ``languages[j]``."""

    def __init__(self, ranked: dict[str, list[int]], length: int):
        self.length = length
        self.languages = sorted(ranked)
        self.grams = np.unique(np.array([g for v in ranked.values() for g in v], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, dtype=np.int64)
        for j, lang in enumerate(self.languages):
            self.ranks[np.searchsorted(self.grams, np.array(ranked[lang], np.int64)), j] = np.arange(len(ranked[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = gram_counts(text) if text else (np.zeros(0), None)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        mine = top_ranked(grams, counts, self.length)
        at = np.searchsorted(self.grams, mine)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != mine)] = len(self.grams)
        theirs = self.ranks[at]
        place = np.where(theirs < 0, self.length, np.abs(theirs - np.arange(len(mine))[:, None])).sum(axis=0)
        best = int(np.argmin(place))
        return self.languages[best], 1.0 - float(place[best]) / (self.length * len(mine))


def learn_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", length: int = PROFILE, max_docs: int = MAX_DOCS_PER_LANGUAGE) -> Profiles:
    """Profiles from labelled documents.  What reaches the driver is the profiles alone, ``length`` rows a language."""
    rows = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    rate = None
    for lang, n in counts.items():
        if n > max_docs:
            test = F.col("lang") == lang
            share = F.lit(int(max_docs / n * (1 << 30)))
            rate = F.when(test, share) if rate is None else rate.when(test, share)
    if rate is not None:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate.otherwise(1 << 30))

    def count(batches):
        found: dict[str, list] = {}
        for batch in small(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    parts = found.setdefault(lang, [])
                    parts.append(gram_counts(text))
                    if len(parts) >= 200:
                        found[lang] = [merged(parts)]
        for lang, parts in found.items():
            grams, n = merged(parts)
            for at in range(0, len(grams), 20_000):
                g = grams[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g), pa.array(n[at : at + 20_000])], names=["lang", "gram", "n"])

    total = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    ranked: dict[str, list[int]] = {}
    for r in total.withColumn("rank", rank).where(F.col("rank") <= length).orderBy("lang", "rank").collect():
        ranked.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(ranked, length)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text if not given), ``lang_pred`` and ``score``."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    shared = shared_model(docs.sparkSession, profiles)
    rows = docs.select(*keep, F.col(text_col).cast("string").alias("__wf_text"))

    def run(batches):
        p = shared()
        for batch in small(batches):
            found = [p.predict(t) for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(run, schema + "lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 5, fold: int = 0):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def language_predictions(docs: DataFrame) -> DataFrame:
    profiles = learn_profiles(docs.where(~held_out()))
    return identify(docs.select("doc_id", held_out().alias("held_out"), "text"), profiles)


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text", min_score: float = MIN_SCORE, languages: list[str] | None = None) -> DataFrame:
    """``docs`` in one of ``languages`` (all that were learned, if not given) at a score of ``min_score`` or more.

    A text without a letter goes; where nothing could be learned, no other does.
    """
    shared = shared_model(docs.sparkSession, profiles)
    at = docs.columns.index(text_col)

    def run(batches):
        p = shared()

        def stays(text):
            if not p.languages:
                return bool(text) and len(padded_words(text)) > 0
            lang, score = p.predict(text)
            return lang != UNKNOWN and score >= min_score and (languages is None or lang in languages)

        for batch in small(batches):
            yield batch.filter(pa.array([stays(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
