"""Outlines of cell sets: rings, holes, corners that touch, and lines that are left out."""

import json
import random

import numpy as np

from tidings.operators import outlines, tracks


def cells_of(spark, picture):
    rows = [(0, -y, x) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"]
    return spark.createDataFrame(rows, "area long, cy long, cx long")


def test_rings_of_a_square_with_a_hole_and_a_cell_that_touches_it(spark):
    cells = cells_of(spark, ["####", "#..#", "####", "....#"])
    got = sorted((r["hole"], len(r["ring"])) for r in outlines.outlines(cells, 1.0).collect())
    assert got == [(False, 5), (False, 5), (True, 5)]
    hole = next(r["ring"] for r in outlines.outlines(cells, 0.5).collect() if r["hole"])
    assert {(p["lat"], p["lon"]) for p in hole} == {(-0.5, 0.5), (0.0, 0.5), (0.0, 1.5), (-0.5, 1.5)} and hole[0] == hole[-1]


def test_cells_inside_outlines_are_the_cells(spark):
    draw = random.Random(5)
    rows = sorted({(a, draw.randint(-9, 9), draw.randint(-9, 9)) for a in (1, 2) for _ in range(150)})
    cells = spark.createDataFrame(rows, "area long, cy long, cx long")
    back = tracks.polygon_cells(outlines.outlines(cells, 0.25), 0.25, holes=True)
    assert sorted(tuple(r) for r in back.select("area", "cy", "cx").collect()) == rows
    made = [json.loads(r["feature"]) for r in outlines.features(outlines.outlines(cells, 0.25)).collect()]
    assert sorted(f["properties"]["area"] for f in made) == [1, 2] and all(line[0] == line[-1] for f in made for line in f["geometry"]["coordinates"])


def test_simplified_rings_stay_near_and_closed():
    stairs = [(k // 2, (k + 1) // 2) for k in range(40)]
    ring = np.array([*stairs, (30, 0), (0, 0)], float)
    got = outlines.simplified(ring, 0.8)
    assert len(got) < 8 and (got[0] == got[-1]).all()
    for p in ring:  # no point is farther from the line that is left than the tolerance
        far = []
        for a, b in zip(got, got[1:]):
            t = np.clip(((p - a) @ (b - a)) / max(1e-12, (b - a) @ (b - a)), 0, 1)
            far.append(np.hypot(*(p - a - t * (b - a))))
        assert min(far) <= 0.8 + 1e-9
    assert len(outlines.simplified(np.array([(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)], float), 50.0)) >= 4
    assert (outlines.simplified(ring, 0.0) == ring).all() or len(outlines.simplified(ring, 0.0)) <= len(ring)
