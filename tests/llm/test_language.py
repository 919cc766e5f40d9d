from wayfloor.llm.language import Profiles, gram_counts, identify, keep_identified, language_predictions, learn_profiles, merged, top_ranked


def plain_grams(text, n=3):
    from collections import Counter

    out, words = Counter(), "".join(c if c.isalpha() else " " for c in text.lower()).split()
    if not words:
        return out
    joined = " " + " ".join(words) + " "
    for k in range(1, n + 1):
        for i in range(len(joined) - k + 1):
            g = joined[i : i + k]
            if " " not in g[1:-1] and g != " ":
                out[g] += 1
    return out


def packed(gram):
    value = 0
    for c in gram:
        value = value << 21 | (1 if c == " " else ord(c) + 2)
    return value


def test_gram_counts_match_a_plain_count():
    for text in ["Hello world", "a", "ab  cd--ef", "É, ça va?\nOui", "!x!", "word" * 50]:
        grams, counts = gram_counts(text)
        assert dict(zip(grams.tolist(), counts.tolist())) == {packed(g): n for g, n in plain_grams(text).items()}


def test_chunks_do_not_change_counts(monkeypatch):
    import wayfloor.llm.language as module

    text = "The quick brown fox, jumps over the lazy dog. " * 20
    whole = gram_counts(text)
    monkeypatch.setattr(module, "_CHUNK", 7)
    cut = gram_counts(text)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def brute_predict(ranked, text, length):
    grams, counts = gram_counts(text)
    mine = sorted(zip((-counts).tolist(), grams.tolist()))[:length]
    best = {}
    for lang, profile in ranked.items():
        place = {g: i for i, g in enumerate(profile)}
        best[lang] = sum(abs(place[g] - i) if g in place else length for i, (_, g) in enumerate(mine))
    return min(sorted(best), key=best.get)


def test_prediction_is_least_out_of_place(spark, edge_docs, empty_docs):
    en, de = "the cat and the dog run over there " * 5, "der hund und die katze laufen über die straße " * 5
    docs = spark.createDataFrame([(i, t, lang) for i in range(10) for t, lang in ((en, "en"), (de, "de"))], "doc_id long, text string, lang string")
    p = learn_profiles(docs, length=50)
    ranked = {k: top_ranked(*merged([gram_counts(t)]), 50).tolist() for k, t in (("en", en), ("de", de))}
    for text in ["the dog", "die katze", "über", "x", "straße und there"]:
        assert p.predict(text)[0] == brute_predict(ranked, text, 50)
    got = {r.doc_id: r for r in identify(edge_docs.where("doc_id is not null"), p).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[4].lang_pred == "und" and got[6].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert identify(empty_docs, p).count() == 0
    assert {r.text for r in keep_identified(edge_docs, p).collect()}.isdisjoint({None, "", " "})
    assert language_predictions(empty_docs).count() == 0
    assert language_predictions(edge_docs).count() == edge_docs.count()
    assert Profiles({}, 50).predict("text") == ("und", 0.0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)


def test_the_stage_rejects_what_is_in_no_learned_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    p = learn_profiles(docs)
    rng = __import__("random").Random(1)
    cyrillic = "".join(chr(rng.randint(0x430, 0x44F)) if rng.random() < 0.8 else " " for _ in range(600))
    letters = "".join(rng.choice("qxzjkwvyf ") for _ in range(600))
    han = "".join(chr(rng.randint(0x4E00, 0x9FA5)) for _ in range(300))
    mine = spark.createDataFrame([(1, cyrillic), (2, letters), (3, han), (4, "123"), (5, None)], "doc_id long, text string")
    assert keep_identified(mine, p).count() == 0
    clean = docs.where("text IS NOT NULL AND regexp_count(text, '[a-zA-Z]') > 0")
    assert keep_identified(clean, p).count() == clean.count()
    assert set(r.lang_pred for r in identify(keep_identified(clean, p, languages=["fr"]), p).collect()) == {"fr"}
    nothing = Profiles({}, 50)
    assert {r.doc_id for r in keep_identified(mine, nothing).collect()} == {1, 2, 3}
