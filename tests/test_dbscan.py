"""DBSCAN of many rows at one point against brute force."""

import random

from siftline.operators import ml


def test_rows_at_one_point_are_paired_once(spark, monkeypatch):
    rng, pairs, neighbours = random.Random(2), [], ml._neighbours
    monkeypatch.setattr(ml, "_neighbours", lambda *a: pairs.append(neighbours(*a)) or pairs[-1])
    spots = [(float(rng.randint(0, 12)), rng.randint(0, 12) * 0.5) for _ in range(30)]
    rows = [(i + 1, *spots[min(i % 40, 29)]) for i in range(800)] + [(None, *spots[0]), (None, 90.0, 90.0), (None, 90.0, 90.0), (2000, 50.0, 50.0), (2001, 50.0, 51.0), (2002, 50.0, 52.0), (2003, 50.0, 53.0), (2004, None, 1.0), (2005, -0.0, -50.0), (2006, 0.0, -50.0)]
    got = sorted(map(repr, map(tuple, ml.dbscan(spark.createDataFrame(rows, "id bigint, n double, cluster double"), ["n", "cluster"], 1.0, 3).collect())))
    assert pairs[0].count() <= 40 * 40
    kept = [r for r in rows if None not in r]
    near = lambda p: [q for q in kept if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 1]
    core = {p[0]: near(p) for p in kept if len(near(p)) >= 3}
    label = {i: i for i in core}
    moved = True
    while moved:
        moved = False
        for i, around in core.items():
            low = min(label[q[0]] for q in around if q[0] in core)
            moved, label[i] = moved or low < label[i], low
    reach = lambda p: label.get(p[0], min((label[q[0]] for q in near(p) if q[0] in core), default=-1))
    assert got == sorted(repr((p[0], reach(p), p[0] in core)) for p in kept)
    assert len({reach(p) for p in kept}) > 3 and any(reach(p) != -1 and p[0] not in core for p in kept)
