import random
import re
from collections import Counter

import pytest

from wayfloor.llm import collocations as operator
from wayfloor.llm.collocations import collocations, distinct_pieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, longest=4, top=2000, percent=80):
    """The definition, over (text, lang)."""
    f, n, langs = Counter(), Counter(), set()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    out = []
    frequent = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for lang in {key[0] for key in frequent}:
        found = []
        mine = {w: a for (l, w), a in frequent.items() if l == lang}
        for w, a in mine.items():
            if any(len(v) > len(w) and 100 * b >= percent * a and any(v[i : i + len(w)] == w for i in range(len(v))) for v, b in mine.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            found.append((-score, -a, " ".join(w).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def shown(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, size=220):
    rng = random.Random(seed)
    words = ["The", "new", "york", "times", "É", "é", "of", "state", "x y", "日本", "a\x1cb", "z", "NUL\x00"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", "!", " ?"]
    rows = []
    for _ in range(size):
        t = "".join(rng.choice(words[: rng.choice([4, 13])]) + rng.choice(marks) for _ in range(rng.randint(0, 60)))
        rows += [(t, rng.choice(["en", "en", "en", "de", None, "und"]))] * rng.choice([1, 1, 1, 5])
    return rows + [(None, "en"), ("", None), (" \t. ", "de")]


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases_match_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    df = spark.createDataFrame([(t, l, 1, "x") for t, l in rows], "text string, lang string, words int, phrase string").repartition(5)
    want = brute(rows)
    assert len(want) > 20
    assert shown(collocations(df)) == want
    monkeypatch.setattr(operator, "FLUSH_WORDS", 20)
    monkeypatch.setattr(operator, "FLUSH_PIECES", 10)
    assert shown(collocations(df, least=7, longest=3, top=20, percent=60)) == brute(rows, 7, 3, 20, 60)
    assert shown(collocations(df, least=300, longest=5)) == brute(rows, 300, 5)


def test_a_full_bitmap_loses_nothing(spark, monkeypatch):
    rows = corpus(3)
    monkeypatch.setattr(operator, "BITMAP_BITS", 64)
    assert shown(collocations(spark.createDataFrame(rows, "text string, lang string"))) == brute(rows)


def test_long_piece_and_common_phrase(spark):
    rows = [("ab cd " * 20_000, "en"), ("one common line here", "en")] * 2 + [("one common line here", "en")] * 300
    assert shown(collocations(spark.createDataFrame(rows, "text string, lang string"))) == brute(rows)


def test_pieces_have_multiplicities(spark):
    df = spark.createDataFrame([("A b. a  b, É", "en"), ("a\tb", "en"), ("a b", None)], "text string, lang string")
    assert sorted(tuple(r) for r in distinct_pieces(df).collect()) == [("en", "a b", 2, 3), ("en", "É", 1, 1), ("und", "a b", 2, 1)]


def test_edges(edge_docs, empty_docs):
    assert shown(collocations(edge_docs)) == []
    assert shown(collocations(edge_docs, least=1)) == brute([(r.text, r.lang) for r in edge_docs.collect()], 1)
    assert shown(collocations(empty_docs)) == []
