import corpus_pipeline
from tests.llm.test_decontaminate import brute as brute_contamination
from tests.llm.test_minhash import brute as brute_classes
from wayfloor.llm.bpe import encoder, tokenizer_path
from wayfloor.llm.secrets import redact_text

import public_tokenizers


def test_stages_match_brute_force(spark, tmp_path):
    item = " ".join(f"q{i} alpha" for i in range(15))
    base = "the cat sat on a mat and looked at the moon while rain fell over all roofs of town " * 2
    rows = [
        (1, base), (2, base + "again"), (3, base), (4, "!!! ???"), (5, None), (6, item), (7, "plain text with password=hunter2hunter2 in it"),
        (8, " ".join(f"f{i}" for i in range(700)) + " " + item), (9, "étude numéro neuf " * 9), (10, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    left = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    least = brute_classes(left)
    left = [(i, t) for i, t in left if least[i] == i]
    bad = brute_contamination(left, [(1, item)])
    left = [(i, redact_text(t, "[SECRET]")) for i, t in left if not bad[i][4]]
    enc = encoder(tokenizer_path(), public_tokenizers.PATTERN)
    want = {i: enc.encode_ordinary(t) for i, t in left}
    got = {r.doc_id: list(r["ids"]) for r in corpus_pipeline.run(spark, d).collect()}
    assert got == want and set(got) == {1, 7, 8, 9}
    assert "[SECRET]" in dict(left)[7]


def test_stages_keep_the_columns(spark, edge_docs, empty_docs, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "word")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for docs in (edge_docs, empty_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, d)
            assert docs.columns == edge_docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == docs.count()
