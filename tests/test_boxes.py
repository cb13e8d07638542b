"""Difference from guards: pieces don't overlap and cover exactly what no guard covers."""

import random

from quire.operators import boxes as B


def sweep(rect, guards):
    """Area of ``rect`` outside all guards, by cells between all edges."""
    xs = sorted({rect[0], rect[2], *(x for g in guards for x in (g[0], g[2]) if rect[0] < x < rect[2])})
    ys = sorted({rect[1], rect[3], *(y for g in guards for y in (g[1], g[3]) if rect[1] < y < rect[3])})
    area = 0.0
    for a, b in zip(xs, xs[1:]):
        for c, d in zip(ys, ys[1:]):
            x, y = (a + b) / 2, (c + d) / 2
            if not any(g[0] <= x <= g[2] and g[1] <= y <= g[3] for g in guards):
                area += (b - a) * (d - c)
    return area


def test_pieces_equal_an_exact_sweep(spark):
    rng = random.Random(6)
    rects, guards = [], []
    for p in range(60):
        for k in range(4):
            x, y = rng.randrange(0, 200), rng.randrange(0, 200)
            rects.append((p, k, (float(x), float(y), float(x + rng.randrange(5, 120)), float(y + rng.randrange(5, 80)))))
        for k in range(rng.randrange(0, 9)):
            x, y = rng.randrange(0, 250), rng.randrange(0, 250)
            guards.append((p, k, (float(x), float(y), float(x + rng.randrange(2, 90)), float(y + rng.randrange(2, 90)))))
    schema = "page int, id int, r struct<x0:double,y0:double,x1:double,y1:double>"
    got = B.subtract_all(spark.createDataFrame(rects, schema), spark.createDataFrame(guards, schema), ["page"]).collect()
    pieces = {}
    for r in got:
        pieces.setdefault((r["page"], r["id"]), []).append(tuple(r["r"]))
    most = 0
    for p, k, rect in rects:
        own, mine = [g for q, _, g in guards if q == p], pieces.get((p, k), [])
        assert abs(sum((x1 - x0) * (y1 - y0) for x0, y0, x1, y1 in mine) - sweep(rect, own)) < 1e-6
        assert all(min(a[2], b[2]) <= max(a[0], b[0]) or min(a[3], b[3]) <= max(a[1], b[1]) for i, a in enumerate(mine) for b in mine[:i])
        most = max(most, len(mine))
    assert most > 4
    empty = spark.createDataFrame([], schema)
    assert B.subtract_all(spark.createDataFrame(rects, schema), empty, ["page"]).count() == len(rects) and B.subtract_all(empty, empty, ["page"]).count() == 0
