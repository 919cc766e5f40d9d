"""Relocation against a plain search on a small map."""

from collections import deque

from wayfloor.operators import relocation as X

ROOM = ["#" * 58, *["#" + "." * 56 + "#"] * 6, "#" * 26 + "...." + "#" * 28, *["#" * 26 + "OOOO" + "#" * 28] * 2, *["#" + "." * 56 + "#"] * 4, "#" * 58]
H, W = len(ROOM), len(ROOM[0])
THING = [(y, x) for y in range(H) for x in range(W) if ROOM[y][x] == "O"]


def reach(blocked):
    """Cells of the largest component of what is free after growing obstacles by one cell; of equal ones the first."""
    free = {(y, x) for y in range(H) for x in range(W) if not any((y + a, x + b) in blocked for a in (-1, 0, 1) for b in (-1, 0, 1))}
    best, left = set(), set(free)
    for c in sorted(free):
        if c in left:
            part, ring = {c}, deque([c])
            while ring:
                y, x = ring.popleft()
                for n in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if n in free and n not in part:
                        part.add(n)
                        ring.append(n)
            left -= part
            best = part if len(part) > len(best) else best
    return best


def cells(spark):
    rows = [(y, x, ROOM[y][x] != ".", ROOM[y][x] != "#") for y in range(H) for x in range(W)]
    return spark.createDataFrame(rows, "gy long, gx long, blocked boolean, floor boolean")


def test_zones(spark):
    blocked = {(y, x) for y in range(H) for x in range(W) if ROOM[y][x] != "."}
    floor = {(y, x) for y in range(H) for x in range(W) if ROOM[y][x] != "#"}
    own = set(THING)
    before, gone = len(reach(blocked) & floor), blocked - own
    open_ = reach(gone) & floor
    tall, wide = 2, 4
    thing = spark.createDataFrame(THING, "gy long, gx long")
    got = X.relocation_zones(cells(spark), thing, 1, 1, 0.1, relax=3, k=80).collect()
    fits = {(y, x) for y, x in open_ if all((y + a, x + b) in open_ and (y + a, x + b) not in gone for a in range(tall) for b in range(wide))}
    walls = lambda y, x: sum((y + a, x + b) in blocked for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b)
    busy = {(y + a, x + b) for y, x in reach(blocked) & floor for a in (-1, 0, 1) for b in (-1, 0, 1)}
    tried = []
    for y, x in sorted(fits, key=lambda c: (-(walls(*c) - 1000 * (c in busy)), c)):
        if len(tried) < X.TRIED and all(abs(y - a) + abs(x - b) >= X.APART for a, b in tried):
            tried.append((y, x))
    want = {}
    for y, x in tried:
        after = len(reach(gone | {(y + a, x + b) for a in range(tall) for b in range(wide)}) & floor)
        away = ((y + 1 - 8.5) ** 2 + (x + 2 - 27.5) ** 2) ** 0.5 * 0.1
        if after > before and away <= 8:
            want[y, x] = (round((after - before) * 0.01, 9), round(away, 9))
    assert {(r.gy, r.gx): (round(r.gain, 9), round(r.distance, 9)) for r in got} == want and want
    assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    strict = X.relocation_zones(cells(spark), thing, 1, 1, 0.1, relax=0, k=80).collect()
    assert {(r.gy, r.gx) for r in strict} <= {c for c in fits if not any((c[0] + a, c[1] + b) in busy for a in range(tall) for b in range(wide))}


def test_greedy_relocation(spark):
    objects = spark.createDataFrame([(7, y, x) for y, x in THING], "component long, gy long, gx long")
    after, moves = X.relocate(cells(spark), objects, [7], 1, 1, 0.1)
    assert len(moves) == 1 and moves[0]["gain"] > 0
    now = {(r.gy, r.gx) for r in after.where("blocked").collect()}
    assert not now & set(THING) and len(now) == sum(c != "." for r in ROOM for c in r)


def test_objects_compete_for_a_place(spark):
    """Two objects bar two passages; each goes to the place that is best on the map the one before has left."""
    room = [r.replace("O", ".") for r in ROOM]
    room[7:10] = [r[:40] + "..." + r[43:] for r in room[7:10]]
    things = {1: THING, 2: [(y, x) for y in (8, 9) for x in (40, 41, 42)]}
    filled = {c for t in things.values() for c in t}
    rows = [(y, x, room[y][x] == "#" or (y, x) in filled, room[y][x] != "#") for y in range(H) for x in range(W)]
    objects = spark.createDataFrame([(i, y, x) for i, t in things.items() for y, x in t], "component long, gy long, gx long")
    start = spark.createDataFrame(rows, "gy long, gx long, blocked boolean, floor boolean")
    after, moves = X.relocate(start, objects, [1, 2], 1, 1, 0.1)
    cells_ = start
    for m in moves:
        thing = objects.where(f"component = {m['component']}").select("gy", "gx")
        for relax in (0, 1, 2):
            best = X.relocation_zones(cells_, thing, 1, 1, 0.1, relax=relax, k=1).collect()
            if best:
                break
        assert (best[0].gy, best[0].gx, relax) == (m["gy"], m["gx"], m["relax"])
        cells_ = X.relocated(cells_, thing, m["gy"] - min(y for y, _ in things[m["component"]]), m["gx"] - min(x for _, x in things[m["component"]]))
    assert moves and moves[0]["component"] == 1
    assert sorted((r.gy, r.gx) for r in cells_.where("blocked").collect()) == sorted((r.gy, r.gx) for r in after.where("blocked").collect())
