import random

from tests.llm.test_minhash import brute, words
from wayfloor.llm.paragraphs import Texts, line_bands, paragraphs, remove_repeats, repeated_paragraphs


def text_of(rng, n, vocab=4000):
    return " ".join(f"v{rng.randrange(vocab)}" for _ in range(n))


def sentences(rng, n):
    return " ".join(text_of(rng, rng.randint(5, 10)).capitalize() + "." for _ in range(n))


def test_line_classes_match_brute_force(spark):
    rng = random.Random(5)
    bases = [text_of(rng, rng.choice([25, 40, 90])) for _ in range(12)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(rng.randint(1, 5)):
            w = rng.choice(bases).split() if rng.random() < 0.6 else text_of(rng, rng.choice([8, 22, 50])).split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                w[rng.randrange(len(w))] = f"n{rng.random()}"
            lines.append(" ".join(w))
        docs.append((d, "\n".join(lines)))
    got = repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    lines, at = [], {}
    for d, t in docs:
        pos = 0
        for x in t.split("\n"):
            if len(words(x)) >= 20:
                at[(d, pos)] = len(lines)
                lines.append((len(lines), x))
            pos += len(x) + 1
    comp = brute(lines)
    size = {c: list(comp.values()).count(c) for c in comp.values()}
    want = {k for k, i in at.items() if size[comp[i]] > 1}
    mine = {(r.doc_id, r.begin): r for r in got if (r.doc_id, r.begin) in at}
    assert set(mine) == want
    for a in want:
        for b in want:
            assert (mine[a].component == mine[b].component) == (comp[at[a]] == comp[at[b]])
    assert all(r.removed == (comp[at[k]] != at[k]) for k, r in mine.items())


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(6)
    for inner in (" ", "\n"):
        docs, planted = [], []
        for i in range(30):
            parts = [text_of(rng, rng.randint(3, 9)).capitalize() + "."]
            while sum(len(p.split()) for p in parts) <= 50:
                parts.append(text_of(rng, rng.randint(3, 9)).capitalize() + ".")
            passage = inner.join(parts)
            for copy in range(2):
                docs.append((2 * i + copy, sentences(rng, 6) + " " + passage + " " + sentences(rng, 6)))
            planted += [2 * i, 2 * i + 1]
        docs += [(1000 + i, sentences(rng, 20)) for i in range(20)]
        found = {r.doc_id for r in repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
        assert found == set(planted)


def test_first_stays_and_the_rest_goes(spark):
    rng = random.Random(8)
    p, own = text_of(rng, 30), [text_of(rng, 25) for _ in range(3)]
    docs = spark.createDataFrame([(2, f"{own[0]}\n{p}\nend"), (1, f"{p}\n{own[1]}"), (3, f"x\n{p}"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in remove_repeats(docs).collect()}
    assert got == {1: f"{p}\n{own[1]}", 2: f"{own[0]}\n\nend", 3: "x\n", 4: None}


def test_edges(edge_docs, empty_docs):
    assert repeated_paragraphs(empty_docs).count() == 0
    assert remove_repeats(edge_docs).count() == edge_docs.count()
    assert remove_repeats(edge_docs).columns == edge_docs.columns
    assert len(paragraphs(Texts([b"a. " * 200]))[1]) > 0


def test_exact_runs_of_50_words_are_found_without_sentences(spark):
    rng = random.Random(9)
    unpunctuated, short, wrapped, long_sentences = (text_of(rng, n, 10**6) for n in (70, 51, 60, 52))
    a, b = long_sentences[:150].rsplit(" ", 1)[0], long_sentences[150:].split(" ", 1)[1]
    long_sentences = f"{a}. {b}."
    split = lambda n: "\n".join(" ".join(wrapped.split()[i : i + n]) for i in range(0, 60, n))
    own = lambda n: text_of(rng, n, 10**6)
    passages = [(unpunctuated, unpunctuated), (short, short), (split(9), split(13)), (long_sentences, long_sentences)]
    docs = []
    for i, (p, q) in enumerate(passages):
        n = 4 if i == 1 else 100
        docs += [(2 * i, f"{own(n)} {p} {own(n)}"), (2 * i + 1, f"{own(n)} {q} {own(n + 3)}")]
    docs += [(100 + i, own(120)) for i in range(5)]
    texts = dict(docs)
    got = [r for r in repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect() if r.n_words >= 50]
    mine = {r.doc_id: (words(texts[r.doc_id].encode()[r.begin : r.end].decode()), r.first_id, r.removed) for r in got}
    assert len(got) == len(mine)
    assert mine == {2 * i + c: (words(p), 2 * i, c == 1) for i, (p, _) in enumerate(passages) for c in (0, 1)}


def test_runs_of_50_words_match_brute_force(spark):
    rng = random.Random(10)
    bases = [[f"w{rng.randrange(10**6)}" for _ in range(130)] for _ in range(3)] + [["x"] * 130]
    docs = []
    for d in range(24):
        w = []
        for _ in range(3):
            w += [f"o{rng.random()}" for _ in range(rng.randint(0, 20))]
            base, at = rng.choice(bases), rng.randrange(80)
            w += base[at : at + rng.randint(30, 110)]
        docs.append((d, " ".join(w)))
    places, text = {}, {d: t.split() for d, t in docs}
    text = {d: [x for w in ws for x in words(w)] for d, ws in text.items()}
    for d, w in text.items():
        for i in range(len(w) - 49):
            places.setdefault(tuple(w[i : i + 50]), []).append((d, i))
    want = set()
    for (d0, i0), *others in (sorted(p) for p in places.values()):
        want |= {(d, i + k) for d, i in others if d != d0 or i >= i0 + 50 for k in range(50)}
    got = set()
    for r in repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        if r.removed and r.n_words >= 50:
            data = dict(docs)[r.doc_id].encode()
            at = len(words(data[: r.begin].decode()))
            here = set((r.doc_id, at + k) for k in range(len(words(data[r.begin : r.end].decode()))))
            if len(here) < len(text[r.doc_id]):  # not a whole line
                got |= here
    assert got == want


def test_short_lines_are_compared_in_blocks(spark):
    rng = random.Random(11)
    own = lambda n: text_of(rng, n, 10**6)
    wrap = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    other_width, added, changed, stanzas = (own(n).split() for n in (30, 32, 48, 36))
    pairs = [
        (wrap(other_width, 9), wrap(other_width, 13)),
        (wrap(added, 16), wrap(added + ["more"], 16)),
        (wrap(changed, 8), wrap(["first", *changed[1:]], 11)),
        ("\n\n".join(" ".join(stanzas[i : i + 12]) for i in (0, 12, 24)), wrap(stanzas, 12)),
        (wrap(own(19).split(), 7),) * 2,
    ]
    docs = []
    for i, (p, q) in enumerate(pairs):
        docs += [(2 * i, f"{own(25)}\n{p}\n{own(25)}"), (2 * i + 1, f"{wrap(own(40).split(), 10)}\n\n{q}\n\n{wrap(own(22).split(), 11)}")]
    texts = dict(docs)
    got = {}
    for r in repeated_paragraphs(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, set()).add((texts[r.doc_id].encode()[r.begin : r.end].decode(), r.first_id, r.removed))
    for i, (p, q) in enumerate(pairs[:4]):
        assert (p, 2 * i, False) in got[2 * i] and (q, 2 * i, True) in got[2 * i + 1]
    assert set(got) == set(range(8))


def test_texts_together_are_read_like_each_alone():
    rng = random.Random(12)
    texts = ["\n".join(sentences(rng, rng.randint(1, 12)) if rng.random() < 0.5 else text_of(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 8))).encode() for _ in range(40)]
    texts += [b"one", b"\n\n", b"...", b"a " * 30000]

    def read(batch):
        t = Texts(batch)
        begin, end, lines = paragraphs(t)
        bands = line_bands(t.shingles, begin[:lines], end[:lines], 3, 2)
        out = [[] for _ in batch]
        for k, (x, y) in enumerate(zip(begin.tolist(), end.tolist())):
            d = t.doc[x]
            out[d].append((k < lines, int(t.spans[x, 0] - t.start[d]), int(t.spans[y - 1, 1] - t.start[d]), tuple(bands[k]) if k < lines else None))
        return [sorted(o, key=str) for o in out]

    assert read(texts) == [read([t])[0] for t in texts]


def test_repeats_inside_one_document_are_no_copies(spark):
    rng = random.Random(13)
    line, shared = text_of(rng, 60, 10**6), text_of(rng, 70, 10**6)
    docs = [(1, f"{line}\n{text_of(rng, 30, 10**6)}\n{line}"), (2, shared), (3, f"x\n{shared}"), (4, "Of " * 300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in repeated_paragraphs(df, within=False).collect()} == {2, 3}
    assert {r.doc_id for r in repeated_paragraphs(df).collect()} >= {1, 2, 3}
    assert {r.doc_id: r.text.count(line) for r in remove_repeats(df).collect()}[1] == 1
