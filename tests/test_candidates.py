"""Candidates for removal against a plain version, on a map with more of them than 120."""

import random

from wayfloor.operators import horizontal as H
from wayfloor.operators import semantic as S


def test_every_candidate_has_its_rank(spark):
    rng, margin, height, width = random.Random(5), 2, 150, 160
    objects = [(y, x, rng.choice([9, 13, 14, 17]), rng.choice([3, 4, 4, 5])) for y in range(2, height - 8, 9) for x in range(2, width - 8, 9)]
    label = {(y + a, x + b): k for y, x, k, size in objects for a in range(size) for b in range(size)}
    lost = {(y, x) for y in range(height) for x in range(width) if (y, x) not in label and rng.random() < 0.03}
    cells = [(y, x, (y, x) in label, (y, x) not in label, (y, x) not in label and (y, x) not in lost) for y in range(height) for x in range(width)]
    names = {i: (n, f, S.PRIORITY.index(f)) for i, n, f, *_ in S.LABELS}
    want = []
    for y, x, k, size in objects:
        box = {(a, b) for a in range(y - margin, y + size + margin) for b in range(x - margin, x + size + margin)}
        if size >= 4 and box & lost:
            want.append((names[k][2], -len(box & lost), -size * size, k, y, x))
    assert len(want) > 120
    got = H.removal_candidates(
        spark.createDataFrame(cells, "gy long, gx long, blocked boolean, floor boolean, accessible boolean"),
        spark.createDataFrame([(y, x, k) for (y, x), k in label.items()], "gy long, gx long, label int"), S.label_dimension(spark), 0.05, margin,
    ).collect()
    found = [(S.PRIORITY.index(r.fixation), -round(r.unlock_area / 0.0025), -r.cells, r.label, r.y0, r.x0) for r in sorted(got, key=lambda r: r.rank)]
    assert found == sorted(want) and sorted(r.rank for r in got) == list(range(1, len(want) + 1))
