import numpy as np
import pytest

from wayfloor.llm import embeddings
from wayfloor.llm.embeddings import codes_of, learn_rotation, near_duplicate_vectors, tables


def brute(rows, threshold=0.98):
    ok = [v is not None and len(v) > 0 and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v, label in rows]
    n = len(rows)
    comp = list(range(n))
    links = [0] * n

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    comp[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], links[i], least[find(i)], least[find(i)] == r[0]) for i, r in enumerate(rows))


def fixture(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        base = rng.normal(size=64)
        for _ in range(rng.integers(1, 6)):
            v = (base + rng.normal(size=64) * rng.choice([0.0, 0.03, 0.1])) * rng.choice([0.5, 1, 7])
            rows.append((len(rows), v.astype(np.float32).tolist(), int(rng.integers(0, 3))))
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [float("inf")] * 64, [None] + [1.0] * 63, [1.0, 2.0], [1.0, 2.0]]
    rows += [(len(rows) + i, v, 1) for i, v in enumerate(odd)] + [(900, [1.0] * 64, None), (901, [1.0] * 64, None), (5, rows[5][1], rows[5][2])]
    return rows


def test_links_and_components_match_brute_force(spark):
    rows = fixture()
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("vectors", [300, 1 << 16, 1 << 21])
@pytest.mark.parametrize("mean_norm", [0.0, 0.7, 0.8])
def test_recall_on_pairs_at_the_threshold(vectors, mean_norm):
    """The width and number of tables of small, large and very large labels, with and without a common mean."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20000, 64))
    x[:, 0] = 0
    x *= np.sqrt(1 - mean_norm**2) / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] = mean_norm
    step = rng.normal(size=x.shape)
    step[:, 0] = 0
    step -= (step * x).sum(1, keepdims=True) * x / (x * x).sum(1, keepdims=True)
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * step
    width, number = tables(vectors)
    mean, projection = learn_rotation(x[:5000], width * number)
    (a, many), (b, others) = codes_of(x, mean, projection, width), codes_of(y, mean, projection, width)
    assert abs(np.unpackbits(a.view(np.uint8)).mean() - 0.5) < 0.05
    found = (many == others).any(axis=1) & (np.bitwise_count((a ^ b).view(np.uint64)) <= embeddings.MAX_HAMMING)
    assert found.mean() >= (0.97 if mean_norm < 0.8 else 0.93)


def test_hot_keys_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "HOT", 4)
    monkeypatch.setattr(embeddings, "BLOCK", 3)
    rng = np.random.default_rng(7)
    base = [rng.normal(size=16) for _ in range(4)]
    rows = [(i, (base[i % 4] + rng.normal(size=16) * (0.12 if i % 3 else 0.2)).tolist(), i % 2 if i % 4 else 0) for i in range(160)]
    rows += [(200 + i, rows[i][1], rows[i][2]) for i in range(0, 30, 3)]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want = brute(rows)
    found, true = sum(r.n_links for r in got), sum(r[1] for r in want)
    assert true > 2000 and found <= true and found >= 0.99 * true
    assert sorted((r.vec_id, r.component_id) for r in got) == [(r[0], r[2]) for r in want]


def test_extra_columns_are_ignored(spark):
    rows = [(*r, "x", 1) for r in fixture()[:20]]
    got = near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node string, n int"))
    assert sorted(tuple(r) for r in got.collect()) == brute([r[:3] for r in rows])


def test_empty_table(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
