"""Outlines of areas on the grid (GEO1, SNK7): boundary edges linked into closed rings, holes as rings of their own, then simplified."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.operators.graph import components, saved

#: Directions of an edge, counterclockwise: east, north, west, south.
STEPS = ((0, 1), (1, 0), (0, -1), (-1, 0))


def boundary(cells: DataFrame) -> DataFrame:
    """area, y, x, way: the edges between a cell of the area and one that is not, from corner (y, x), with the area to their left."""
    corners = ((0, 0, 0), (0, 1, 1), (1, 1, 2), (1, 0, 3))  # where a cell's four edges begin, and their ways
    edges = cells.select("area", F.explode(F.array(*[F.struct((F.col("cy") + y).alias("y"), (F.col("cx") + x).alias("x"), F.lit(way).alias("way")) for y, x, way in corners])).alias("e")).select("area", "e.*")
    step = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in STEPS]), F.col("way") + 1)
    back = edges.select("area", (F.col("y") + step(0)).alias("y"), (F.col("x") + step(1)).alias("x"), ((F.col("way") + 2) % 4).alias("way"))
    return edges.join(back, ["area", "y", "x", "way"], "left_anti")


def rings(cells: DataFrame, rounds: int = 40) -> DataFrame:
    """area, ring, at, y, x: the corners of each closed ring in order. Outer rings run counterclockwise and holes clockwise; cells that touch
    at a corner only have rings of their own.

    An edge is followed by the one that turns left at its end, else goes straight, else turns right. Rings are the components
    of that relation, and an edge's place in its ring comes from pointers that double their reach in each round: rounds
    grow with the logarithm of the longest ring, and no ring has to be in one task for it."""
    e = saved(boundary(cells).withColumn("e", F.monotonically_increasing_id()))
    step = lambda k: F.element_at(F.array(*[F.lit(s[k]) for s in STEPS]), F.col("way") + 1)
    ends = e.select("area", "e", "way", (F.col("y") + step(0)).alias("y"), (F.col("x") + step(1)).alias("x"))
    starts = e.select("area", "y", "x", F.col("way").alias("turn"), F.col("e").alias("next"))
    turn = F.element_at(F.array(F.lit(1), F.lit(0), F.lit(9), F.lit(2)), (F.col("turn") - F.col("way") + 4) % 4 + 1)  # straight, left, back, right
    follows = saved(ends.join(starts, ["area", "y", "x"]).groupBy("e").agg(F.min(F.struct(turn.alias("t"), "next")).alias("b")).select("e", "b.next"))
    label = saved(components(e.select(F.col("e").alias("node")), follows.select(F.col("e").alias("a"), F.col("next").alias("b"))).select(F.col("node").alias("e"), F.col("label").alias("ring")))
    # how far each edge is behind its ring's first one
    at = follows.select(F.col("next").alias("e"), F.col("e").alias("to")).join(label, "e")
    at = saved(at.select("e", "ring", F.when(F.col("e") != F.col("ring"), F.col("to")).alias("to"), (F.col("e") != F.col("ring")).cast("long").alias("at")))
    for _ in range(rounds):
        there = at.select(F.col("e").alias("to"), F.col("to").alias("further"), F.col("at").alias("more"))
        at = saved(at.join(there, "to", "left").select("e", "ring", F.col("further").alias("to"), (F.col("at") + F.coalesce("more", F.lit(0))).alias("at")))
        if at.filter("to is not null").isEmpty():
            return at.join(e, "e").select("area", "ring", "at", "y", "x")
    raise RuntimeError(f"a ring is longer than 2 ** {rounds} edges")


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker: the points of a closed ring (first one repeated last) without those that lie within the tolerance of
    the line that is left. The ring is halved at the point farthest from its first one, so at least a triangle stays."""
    if len(points) < 5:
        return points
    keep = np.zeros(len(points), bool)
    middle = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
    keep[[0, middle, -1]] = True
    todo = [(0, middle), (middle, len(points) - 1)]
    while todo:
        a, z = todo.pop()
        if z - a < 2:
            continue
        line, off = points[z] - points[a], points[a + 1 : z] - points[a]
        size = float(np.hypot(*line))
        far = np.hypot(*off.T) if size == 0 else np.abs(line[0] * off[:, 1] - line[1] * off[:, 0]) / size
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep[a + 1 + k] = True
            todo += [(a, a + 1 + k), (a + 1 + k, z)]
    if keep.sum() < 4:  # a line there and back: the point farthest from it makes it a triangle
        line, off = points[middle] - points[0], points - points[0]
        keep[int(np.argmax(np.abs(line[0] * off[:, 1] - line[1] * off[:, 0])))] = True
    return points[keep]


def outlines(cells: DataFrame, size: float, tolerance: float = 0.0) -> DataFrame:
    """area, hole, ring (array of struct lat, lon; closed): the outline of each area's cells. Points on straight lines are left out, and those
    within ``tolerance`` degrees of the line between others."""
    each = rings(cells).groupBy("area", "ring").agg(F.array_sort(F.collect_list(F.struct("at", "y", "x"))).alias("points"))
    kinds = "area long, hole boolean, ring array<struct<lat:double,lon:double>>"

    def run(frames):
        for f in frames:
            out = []
            for area, points in zip(f["area"], f["points"]):
                p = np.array([(q["y"], q["x"]) for q in points], np.int64)
                turn = np.roll(p, 1, axis=0) + np.roll(p, -1, axis=0) != 2 * p
                p = p[turn.any(axis=1)]
                p = np.r_[p, p[:1]]
                twice = int((p[:-1, 1] * p[1:, 0] - p[1:, 1] * p[:-1, 0]).sum())  # the area, doubled; holes run the other way
                q = simplified(p * size, tolerance) if tolerance > 0 else p * size
                out.append((area, twice < 0, [{"lat": float(y), "lon": float(x)} for y, x in q]))
            yield pd.DataFrame(out, columns=["area", "hole", "ring"])

    return each.select("area", "points").mapInPandas(run, kinds)


def features(outlines_: DataFrame) -> DataFrame:
    """area, feature: each area's outline as a GeoJSON MultiLineString."""
    line = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    g = outlines_.withColumn("line", line).groupBy("area").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    geometry = F.struct(F.lit("MultiLineString").alias("type"), F.col("lines").alias("coordinates"))
    return g.select("area", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("area").alias("properties"))).alias("feature"))
