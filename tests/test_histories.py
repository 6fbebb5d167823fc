"""Walks back through maps, snapshots with fallback, admission under quotas."""

from datetime import date, datetime, timedelta

import pytest

from tidings.operators import histories

DAY = date(2024, 6, 30)


def back(*ago):
    return [DAY - timedelta(days=n) for n in ago]


def walk(days, found):
    """found: days ago -> spots."""
    since, at_least, passed = histories.walked_back(back(*days), {DAY - timedelta(days=n): spots for n, spots in found.items()}, DAY, 50.0, 30.0, 10.0, 4)
    return (DAY - since).days if since else None, at_least, sorted((DAY - d).days for d in passed)


def test_a_walk_follows_the_mark_as_it_moves():
    step = {n: [(50.0 + 0.07 * n, 30.0)] for n in range(6)}  # 8 km a day
    assert walk(range(9), step) == (5, False, [0, 1, 2, 3, 4, 5])
    assert walk(range(6), step) == (5, True, [0, 1, 2, 3, 4, 5])  # as old as the history
    assert walk(range(9), {n: [(50.0 + 0.07 * n, 30.0), (50.0, 30.0)] for n in range(6)})[2] == [0, 1, 2, 3, 4, 5]  # the nearest one is the one that stays
    assert walk(range(9), {3: [(50.2, 30.0)]}) == (None, False, [])  # 22 km off


@pytest.mark.parametrize("days, found, want", [
    (range(12), [0, 1, 6, 7], (7, False, [0, 1, 6, 7])),  # four maps without one are bridged
    (range(12), [0, 1, 7, 8], (1, False, [0, 1])),  # five are not
    ([0, 1, 2, 9, 10], [0, 1, 2, 9], (9, False, [0, 1, 2, 9])),  # no maps for a while, and it is there again
    ([0, 1, 2, 9, 10], [0, 1, 2], (2, True, [0, 1, 2])),  # no maps for a while: it may be older
    ([0, 1, 2, 9, 10], [0, 1], (1, False, [0, 1])),  # it was gone before the maps were
    ([3, 4], [4], (4, True, [4])), ([0], [], (None, False, [])),
])
def test_a_walk_ends_at_gaps(days, found, want):
    assert walk(days, {n: [(50.0, 30.0)] for n in found}) == want


def test_persistence_of_asks_without_maps_or_marks(spark):
    asks = spark.createDataFrame([(1, 7, DAY, 50.0, 30.0), (2, 8, DAY, 50.0, 30.0)], "ask long, track long, day date, lat double, lon double")
    maps = spark.createDataFrame([(7, d) for d in back(0, 1, 400)], "track long, day date")
    marks = spark.createDataFrame([(7, DAY, 50.0, 30.0), (7, DAY + timedelta(days=1), 50.0, 30.0)], "track long, day date, lat double, lon double")
    got = {r["ask"]: tuple(r)[1:] for r in histories.persistence(asks, maps, marks).collect()}
    assert got == {1: (DAY, 1, False, 2, 1), 2: (None, 0, False, 0, 0)}


def test_a_probe_before_the_first_snapshot_gets_the_first_one(spark):
    at = lambda d, h=0: datetime(2024, 1, d, h)
    snaps = spark.createDataFrame([("k", at(5), 1), ("k", at(7, 5), 2), ("k", at(9), 3)], "key string, at timestamp, snap long")
    probes = spark.createDataFrame([("k", at(1), 10), ("k", at(8), 11), ("k", at(10), 12), ("z", at(8), 13)], "key string, t timestamp, id long")
    got = {r["id"]: (r["snap"], r["previous"]) for r in histories.snapshot_and_previous(probes, snaps, "key", "t", "at", "snap", 2).collect()}
    assert got == {10: (1, None), 11: (2, 1), 12: (3, 2), 13: (None, None)}  # 2 is 43 hours before 3: six hours are allowed


def test_admission_rests_on_all_that_was_let_in_before(spark):
    log = [(1, 1, 10, "request"), (1, 2, 11, "request"), (1, 3, 12, "request"), (1, 4, 10, "request"), (1, 5, 10, "retire"), (1, 6, 12, "request"), (1, 7, 99, "retire"), (2, 1, 10, "request"), (2, 2, 11, "request"), (3, 1, 5, "request")]
    got = histories.admitted(spark.createDataFrame(log, "newsroom long, at long, story long, kind string"), spark.createDataFrame([(1, 0), (2, 3)], "newsroom long, n long"), 2, 4)
    assert {(r["newsroom"], r["at"]): r["outcome"] for r in got.collect()} == {
        (1, 1): "hired", (1, 2): "hired", (1, 3): "refused_surge", (1, 4): "already", (1, 6): "hired", (2, 1): "hired", (2, 2): "refused_total", (3, 1): "hired"}
