import hashlib
import random
import re

from wayfloor.llm.decontaminate import contamination_digest, drop_contaminated, find_contamination, remove_spans

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def norm(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=13):
    out = {}
    for doc_id, text in docs:
        words, hit, found = norm(text), set(), set()
        for item_id, item in items:
            w = norm(item)
            size = min(n, len(w))
            for j in range(len(w) - size + 1) if size else ():
                for i in range(len(words) - size + 1):
                    if words[i : i + size] == w[j : j + size]:
                        hit.update(range(i, i + size))
                        found.add(str(item_id))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc_id] = (len(words), len(hit), len(found), sha, bool(hit) and 20 * len(hit) >= len(words))
    return out


def fixture(seed=1):
    rng = random.Random(seed)
    vocab = ["The", "cat", "é", "ßa", "dog9", "a", "B", "c"]
    text = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 3, 12, 13, 14, 40]))) for i in range(24)] + [(100, None), (101, "!!"), (102, "unique")]
    docs = []
    for d in range(60):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            w = (rng.choice(items)[1] or "").split(" ")
            a = rng.randint(0, max(0, len(w) - 1))
            parts += [" ".join(w[a:]), text(rng.randint(0, 30))]
        docs.append((d, " ".join(parts)))
    return docs + [(900, None), (901, ""), (902, "so unique a word")], items


def test_matches_brute_force(spark):
    docs, items = fixture()
    got = contamination_digest(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == brute(docs, items)


def test_shards_give_the_same(spark):
    docs, items = fixture(2)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    key = lambda rows: sorted((r.doc_id, r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) for r in rows)
    assert key(find_contamination(d, b).collect()) == key(find_contamination(d, b, max_automaton_words=60).collect())


def test_drop_and_cut(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, item), (2, "clean text here"), (3, "x " * 600 + item + " tail"), (4, None)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in drop_contaminated(d, b).collect()} == {2, 3, 4}
    cut = {r.doc_id: r.text for r in remove_spans(d, b).collect()}
    assert cut[1] == "" and cut[2] == "clean text here" and cut[3] == "x " * 600 + " tail" and cut[4] is None


def test_edges(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination_digest(edge_docs, none).where("n_hit > 0").count() == 0
    items = spark.createDataFrame([(None, "the cat sat"), (1, "word")], "item_id long, text string")
    assert contamination_digest(edge_docs, items).count() == edge_docs.count()
    assert contamination_digest(empty_docs, items).count() == 0
