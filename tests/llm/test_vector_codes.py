import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from wayfloor.llm.vector_codes import MAX_LONG, code_digest, compress


def brute(rows, parts=4, entries=256, rounds=4):
    """The plain method over (vec_id, vector, label), one distance at a time, in integers of any length."""
    kept = [(i, [math.floor(x * 1024) for x in v], l) for i, v, l in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), c)) for c in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        new = []
        for p in range(parts):
            at = [assign(v, p)[0] for _, v, _ in kept]
            book = []
            for e, c in enumerate(books[p]):
                mine = [cut(v, p) for (_, v, _), a in zip(kept, at) if a == e]
                book.append([sum(x) // len(mine) for x in zip(*mine)] if mine else c)
            new.append(book)
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, of_label = [], {}
    for i, v, l in kept:
        found = [assign(v, p) for p in range(parts)]
        error = sum(d for _, d in found)
        of_label[l] = of_label.get(l, 0) + error
        out.append((i, "".join(f"{a:02x}" for a, _ in found), error, l))
    return sorted(((i, c, e, of_label[l], digest) for i, c, e, l in out), key=str)


def shown(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_codes_match_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.1) for _ in range(8)], rng.choice([None, 0, 1, 1, 1])) for i in range(300)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)] + [rows[5]] * 3 + [(None, rows[9][1], 2)]
    rows += [(2000, None, 1), (2001, [0.1] * 7 + [None], 1), (2002, [float("nan")] + [0.0] * 7, 1), (2003, [float("inf")] + [0.0] * 7, None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("codes", F.lit("other"))
    assert shown(code_digest(df.repartition(7))) == brute(rows)
    few = rows[:40]
    assert shown(code_digest(spark.createDataFrame(few, "vec_id long, embedding array<double>, label int"))) == brute(few)


def test_ties_go_to_the_lower_entry(spark):
    rows = [(1, [0.0, 1.0, 0.0, 0.0], 0), (2, [0.0, 1.0, 2.0, 0.0], 0), (3, [0.0, 1.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = shown(code_digest(df, entries=2))
    assert [r[1] for r in got] == ["00000000", "00000100", "00000000"]
    assert got == brute(rows, entries=2)


def test_large_components_stay_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice([0, 3, 6]) for _ in range(4)], 0) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert shown(code_digest(df, entries=5)) == brute(rows, entries=5)
    huge = spark.createDataFrame([(1, [1e300, 0.0, 0.0, 0.0], 0), (2, [-1e300, 0.0, 0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    coded, books = compress(huge, entries=1)
    assert books.shape == (4, 1, 1) and coded.count() == 2
    assert {r.error for r in code_digest(huge, entries=1).collect()} == {MAX_LONG}


def test_lengths_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    odd = spark.createDataFrame([(1, [0.5, 0.25, 1.0], 0), (2, [0.5], 0), (3, [], 0)], schema)
    assert [(r.vec_id, r.error) for r in code_digest(odd).collect()] == [(1, 0)]
    assert code_digest(odd.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert code_digest(odd.limit(0)).count() == 0
    assert code_digest(odd.where("vec_id = 3")).count() == 0
    assert np.array_equal(compress(odd)[1][:, 0, 0], [512, 256, 1024, 0])
