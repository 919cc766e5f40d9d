import hashlib
import random
from collections import Counter

import pytest

import wayfloor.llm.substrings as module
from wayfloor.llm.substrings import remove_substrings, shared_windows, substring_digest


def brute(rows, size=200):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = [False] * len(d)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fixture(seed=2):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.choice([30, 45, 60, 120])) for _ in range(8)]
    rows = []
    for d in range(50):
        rows.append((d, " ".join(rng.choice(passages) if rng.random() < 0.4 else text(rng.randint(1, 40)) for _ in range(rng.randint(1, 6)))))
    base = text(300)
    for d in range(50, 56):
        w = base.split()
        w[rng.randrange(300)] = word()
        rows.append((d, " ".join(w)))
    return rows + [(60, None), (61, ""), (62, "a" * 199), (63, "a" * 201), (64, "ab" * 400), (65, "x" + "ab" * 150), (66, base), (66, base), (None, base[:700])]


def test_bounded_prefix_groups():
    rng = random.Random(1)
    for _ in range(60):
        alphabet, depth = rng.choice([1, 2, 26, 256]), rng.choice([1, 2, 5, 20, 40])
        parts = [bytes(rng.randrange(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(3)]
        runs = [b"".join(rng.choice(parts)[rng.randint(0, 5) :] for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 10))]
        seen = Counter(r[i : i + depth] for r in runs for i in range(len(r) - depth + 1))
        want = [[seen[r[i : i + depth]] > 1 for i in range(len(r) - depth + 1)] for r in runs]
        assert [m.tolist() for m in shared_windows(runs, depth)] == want


@pytest.mark.parametrize("hot, chunk, batch", [(1_000_000, 1 << 19, 800_000), (2_000, 1 << 19, 800_000), (300, 1 << 19, 800_000), (1_000_000, 300, 1_000)])
def test_matches_brute_force(spark, monkeypatch, hot, chunk, batch):
    monkeypatch.setattr(module, "HOT_BYTES", hot)
    monkeypatch.setattr(module, "_CHUNK", chunk)
    monkeypatch.setattr(module, "BATCH_BYTES", batch)
    rows = fixture()
    got = substring_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_kept_bytes_and_edges(spark, edge_docs, empty_docs):
    assert substring_digest(empty_docs).count() == 0
    assert substring_digest(edge_docs).count() == edge_docs.count()
    rows = fixture(3)[:20]
    want = {r[0]: r[4] for r in brute(rows)}
    got = remove_substrings(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: hashlib.sha256(bytes(r.kept)).hexdigest() for r in got.collect()} == want
