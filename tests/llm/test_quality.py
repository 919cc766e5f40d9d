import numpy as np

from wayfloor.llm.quality import FEATURES, features, fit, quality_scores


def test_features_are_finite():
    for text in [None, "", " ", "\n\n", "a", "!!", "é\U0001f600", "x" * 10000, "a b\n" * 50]:
        row = features(text)
        assert len(row) == len(FEATURES) and np.isfinite(row).all()


def test_tables_learn_main_effects_and_interactions():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, len(FEATURES)))
    y = (((x[:, 0] > 0) ^ (x[:, 1] > 0)) | (x[:, 2] > 1.5)).astype(float)
    model = fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert (((model.score(x[3000:]) > 0.5) == y[3000:]).mean()) > 0.95


def test_score_is_the_sum_of_table_entries():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, len(FEATURES)))
    m = fit(x, (x[:, 3] > 0).astype(float))
    row = x[7]
    total = m.intercept + sum(t[int((c <= v).sum())] for t, c, v in zip(m.tables, m.cuts, row))
    total += sum(t[int((m.pair_cuts[a] <= row[a]).sum()), int((m.pair_cuts[b] <= row[b]).sum())] for (a, b), t in zip(m.pairs, m.pair_tables))
    assert abs(m.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality_scores(spark.read.parquet(f"{d}/documents.parquet"), labels)
    assert got.count() == 1000
    rows = got.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)


def test_edges(spark, edge_docs, empty_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_scores(edge_docs, none)
    assert got.count() == edge_docs.count() and got.where("score <> 0.5").count() == 0
    assert quality_scores(empty_docs, none).count() == 0
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 1), (6, None, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_scores(edge_docs, some).count() == edge_docs.count()
