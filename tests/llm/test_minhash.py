import random
import re
from collections import Counter

import numpy as np

from wayfloor.llm.minhash import dart_signature, dart_signatures, keep_one_of_each, near_duplicates
from wayfloor.llm.shingles import expanded, weighted_shingles, word_hashes

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def plain_set(text):
    w = words(text)
    if not w:
        return {b"bare:" + text.encode().strip()} if text and text.strip() else set()
    count = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    return {(s, k) for s, n in count.items() for k in range(n.bit_length())}


def brute(rows, threshold=0.8):
    sets = [plain_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return {doc_id: least[find(i)] for i, (doc_id, _) in enumerate(rows)}


def test_repeats_weigh(spark):
    """Sets of one shingle set but other weights are apart; the brute force knows weights, too."""
    a, b = "x y z u v w " * 3, "x y z u v w " * 40
    rows = [(1, a), (2, b), (3, b + "x"), (4, a)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows) == {1: 1, 2: 2, 3: 2, 4: 1}


def corpus(seed=1, groups=25):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 120]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows) + i, t) for i, t in enumerate(["", " ", "???", "???", "one", "one", "One!"])]


def test_word_hashes_depend_on_the_word_alone(monkeypatch):
    import wayfloor.llm.shingles as module

    text = "The cat, the CAT; é_é cat1 9".encode()
    h = word_hashes(text)
    assert len(h) == len(words(text.decode())) and h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == len(set(words(text.decode())))
    monkeypatch.setattr(module, "_CHUNK", 4)
    assert (word_hashes(text) == h).all()


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(0)
    for weighted in (False, True):
        a = rng.integers(1, 1 << 62, 300).astype(np.uint64)
        b = np.concatenate((a[:240], rng.integers(1, 1 << 62, 60).astype(np.uint64)))
        wa = rng.integers(1, 9, 300).astype(float) if weighted else np.ones(300)
        wb = np.concatenate((wa[:240], np.full(60, 3.0 if weighted else 1.0)))
        both = np.minimum(wa[:240], wb[:240]).sum()
        want = both / (wa.sum() + wb.sum() - both)
        got = (dart_signature(a, 4000, wa) == dart_signature(b, 4000, wb)).mean()
        assert abs(got - want) < 0.03
    (short, weight), *_ = weighted_shingles([b"one two"])
    assert len(short) == 1 and weight == 1 and len(set(dart_signature(short, 50).tolist())) == 50


def test_sets_together_sign_like_each_alone():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcde") for _ in range(n)).encode() for n in (0, 1, 4, 5, 60, 400)] + [None, b"??", b"same words again " * 90]
    sets = weighted_shingles(texts)
    assert [len(e) for e, _ in sets][:3] == [0, 1, 1] and sets[-1][1].max() == 7
    together = dart_signatures(sets, 40)
    for s, t, row in zip(sets, texts, together):
        (alone,) = weighted_shingles([t])
        assert (alone[0] == s[0]).all() and (alone[1] == s[1]).all() and len(expanded(*s)) == s[1].sum()
        assert (dart_signatures([s], 40)[0] == row).all() and row.any() == bool(len(s[0]))


def test_classes_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_members_that_only_meet_through_each_other(spark):
    """A chain: neighbours are close, the ends are not, and every one shares passages with the first."""
    rng = random.Random(7)
    base = [f"c{i}" for i in range(100)]
    rows = []
    for i in range(8):
        rows.append((i, " ".join(base)))
        for _ in range(2):
            base[rng.randrange(100)] = f"new{rng.random()}"
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_edges(edge_docs, empty_docs):
    got = near_duplicates(edge_docs)
    assert got.count() == edge_docs.count() and near_duplicates(empty_docs).count() == 0
    kept = keep_one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    assert sum(bool(r.text) and r.text.startswith("the cat") for r in kept.collect()) == 1
    assert keep_one_of_each(empty_docs).count() == 0


def test_one_row_of_a_class_stays_whatever_its_ids(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, base + " more"), (2, base), (None, base), (3, "other text of five words"), (3, "other text of five words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, len(r.text or "")) for r in keep_one_of_each(docs).collect())
    assert len(got) == 3 and got[0] == (0, 0) and got[1][0] == 1 and got[2][0] == 3
