"""Quality classifier: a generalised additive model with pairwise interactions (operator 4).

Features of the whole text are binned at quantiles.  Boosting goes round the
features and fits a shallow tree on one feature's bins at a time; the trees of
a feature add up to one lookup table.  The pairs of features that explain most
of what is left get two-dimensional tables in the same way.  A score is the
logistic of the sum of table entries, so scoring is a few vectorised additions.

The model is fitted on at most ``MAX_ROWS`` labelled rows (in expectation),
chosen by a hash of the id, on the driver; every document is scored whole.

Defined cases: null text is scored as the empty text; several labels of one
document count as the least; without labels every score is 0.5.  Extra columns
are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfloor.llm.common import process_cache, shared_model, small

#: Bound of the fitting sample.
MAX_ROWS = 20_000
#: Bins of a feature, boosting rounds over the features and over the pairs, learning rate, number of pairs.
BINS, ROUNDS, PAIR_ROUNDS, RATE, PAIRS, PAIR_BINS = 32, 150, 60, 0.15, 8, 8
THRESHOLD = 0.7

FEATURES = (
    "log_chars", "log_words", "mean_word", "max_word", "letters", "upper", "digits", "punctuation", "symbols", "spaces", "other",
    "log_lines", "mean_line", "ended_lines", "distinct_words", "top_word", "repeated_lines", "repeated_pairs", "symbol_words", "exclaimed",
)

_CLASSES = ("letter", "upper", "digit", "stop", "mark", "symbol", "space", "newline", "other")


def _classes() -> np.ndarray:
    """The class of every code point."""
    cache = process_cache()
    if "quality_classes" not in cache:
        table = np.full(0x110000, 8, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                table[i] = 1 if c.isupper() else 0
            elif c.isdigit():
                table[i] = 2
            elif c.isspace():
                table[i] = 6
        for chars, k in ((".;:,'\"()-", 3), ("!?", 4), ("#$%&*+/<=>@[\\]^_`{|}~", 5), ("\n", 7)):
            for c in chars:
                table[ord(c)] = k
        cache["quality_classes"] = table
    return cache["quality_classes"]


def features(text: str | None) -> list[float]:
    """One row of ``FEATURES``; every value is finite, for the empty text too."""
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter, upper, digit, stop, mark, symbol, space, newline, other = np.bincount(_classes()[codes], minlength=9).tolist()
    n, words, lines = max(1, len(codes)), text.split(), [x for x in text.split("\n") if x]
    counts = Counter(words)
    n_words, n_lines = max(1, len(words)), max(1, len(lines))
    pairs = len(set(zip(words, words[1:]))) if len(words) > 1 else 0
    return [
        float(np.log1p(len(codes))),
        float(np.log1p(len(words))),
        (n - space - newline) / n_words,
        float(max(map(len, counts), default=0)),
        (letter + upper) / n,
        upper / max(1, letter + upper),
        digit / n,
        stop / n,
        symbol / n,
        space / n,
        other / n,
        float(np.log1p(len(lines))),
        float(np.log1p(n / n_lines)),
        sum(x[-1] in ".!?\"'" for x in lines) / n_lines,
        len(counts) / n_words**0.9,
        max(counts.values(), default=0) / n_words,
        1 - len(set(lines)) / n_lines if lines else 0.0,
        1 - pairs / (len(words) - 1) if len(words) > 1 else 0.0,
        sum(c for w, c in counts.items() if not w[-1].isalpha() and w[-1] not in ".,;:") / n_words,
        mark / n_words,
    ]


class AdditiveModel:
    """Intercept, cuts of every feature, lookup tables of features and of pairs."""

    def __init__(self, cuts, tables, pair_cuts, pairs, pair_tables, intercept):
        self.cuts, self.tables, self.pair_cuts = cuts, tables, pair_cuts
        self.pairs, self.pair_tables, self.intercept = pairs, pair_tables, intercept

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_cuts[a], x[:, a], side="right"), np.searchsorted(self.pair_cuts[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 3) -> np.ndarray:
    """Values of a tree of few leaves over the bins of one feature, from their gradient and curvature sums."""
    edges = [0, len(g)]
    gain_of = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1.0)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                gl, hl = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                gain = gl**2 / (hl + 1) + (g[a:b].sum() - gl) ** 2 / (h[a:b].sum() - hl + 1) - gain_of(a, b)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), a + k + 1)
        if best[1] is None:
            break
        edges = sorted([*edges, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1.0)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut into four quadrants of a pair's bins."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)

    def quadrants(s):
        a = s[:-1, :-1]
        b, c = s[:-1, -1:] - a, s[-1:, :-1] - a
        return a, b, c, s[-1, -1] - a - b - c

    parts = list(zip(quadrants(gs), quadrants(hs)))
    gain = sum(x**2 / (y + 1) for x, y in parts)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    a, b, c, d = (x[i, j] / (y[i, j] + 1) for x, y in parts)
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = a, b, c, d
    return float(gain[i, j] - gs[-1, -1] ** 2 / (hs[-1, -1] + 1)), out


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of shallow trees on the features, then on the pairs that explain most of the rest."""
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y):
        return AdditiveModel([np.zeros(0)] * d, [np.zeros(1)] * d, [np.zeros(0)] * d, [], [], 0.0)
    base = float(np.clip(y.mean(), 0.01, 0.99))
    intercept = float(np.log(base / (1 - base)))
    cuts = [_cuts(x[:, j], BINS) for j in range(d)]
    at = [np.searchsorted(cuts[j], x[:, j], side="right") for j in range(d)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    total = np.full(len(y), intercept)
    slopes = lambda: (y - (p := 1 / (1 + np.exp(-total))), p * (1 - p))
    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            size = len(tables[j])
            step = RATE * _tree(np.bincount(at[j], g, size), np.bincount(at[j], h, size))
            tables[j] += step
            total += step[at[j]]
    pair_cuts = [_cuts(x[:, j], PAIR_BINS) for j in range(d)]
    cell = [np.searchsorted(pair_cuts[j], x[:, j], side="right") for j in range(d)]

    def sums(a, b):
        shape = (len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)
        k, (g, h) = cell[a] * shape[1] + cell[b], slopes()
        return k, np.bincount(k, g, shape[0] * shape[1]).reshape(shape), np.bincount(k, h, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_cross(*sums(a, b)[1:])[0], a, b) for a in range(d) for b in range(a + 1, d)), reverse=True)
    pairs = [(a, b) for gain, a, b in gains[:PAIRS] if gain > 0]
    pair_tables = [np.zeros((len(pair_cuts[a]) + 1, len(pair_cuts[b]) + 1)) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (a, b) in zip(pair_tables, pairs):
            k, g, h = sums(a, b)
            step = RATE * _cross(g, h)[1]
            t += step
            total += step.ravel()[k]
    return AdditiveModel(cuts, tables, pair_cuts, pairs, pair_tables, intercept)


def _featured(rows: DataFrame, schema: str, finish) -> DataFrame:
    """Rows whose last column is the text, through ``finish(columns, feature matrix)``."""

    def run(batches):
        for batch in small(batches):
            x = np.array([features(t) for t in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.float64).reshape(-1, len(FEATURES))
            yield finish(batch.columns[:-1], x)

    return rows.mapInArrow(run, schema)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "quality", max_rows: int = MAX_ROWS) -> AdditiveModel:
    """Fit on a sample of the labelled documents.  Its bound makes the ids small enough to broadcast and the features to collect."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(max_rows / n * (1 << 30)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id").select("y", "text")
    many = pa.list_(pa.float64())

    def finish(columns, x):
        return pa.RecordBatch.from_arrays([columns[0], pa.array(list(x), many)], names=["y", "x"])

    got = _featured(rows, "y int, x array<double>", finish).toPandas()
    if not len(got):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    x, y = np.array(got["x"].tolist()), got["y"].to_numpy(dtype=np.float64)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows came in
    return fit(x[order], y[order])


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = learn(docs, labels.where(~held_out()))
    shared = shared_model(docs.sparkSession, model)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def finish(columns, x):
        s = shared().score(x)
        return pa.RecordBatch.from_arrays([*columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    return _featured(rows, f"doc_id {id_type}, held_out boolean, score double, predicted int", finish)
