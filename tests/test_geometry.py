"""Splits along broken lines, shared borders, filed stretches and sampled borders against plain geometry."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrane.operators import barriers, scores  # noqa: E402

RING = "array<struct<x:long,y:long>>"


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def square(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def regions(spark, *rings):
    return spark.createDataFrame([(k, r) for k, r in enumerate(rings)], f"fence int, ring {RING}")


def lines(spark, rows):
    return spark.createDataFrame([(f, b, p, x, y) for f, b, v in rows for p, (x, y) in enumerate(v)], "fence int, barrier string, pos int, x long, y long")


def test_river_splits_a_fence_and_no_barrier_is_a_problem(spark):
    fence = regions(spark, square(113_200_000, 23_000_000, 200_000, 100_000), square(113_900_000, 23_000_000, 10, 10))
    river = lines(spark, [(0, "测试河", [(113_300_000, 22_990_000), (113_300_000, 23_110_000)])])
    stores = spark.createDataFrame([("W1", 113_250_000, 23_050_000), ("E1", 113_350_000, 23_050_000), ("E2", 113_380_000, 23_080_000), ("out", 113_500_000, 23_050_000)], "store_id string, x long, y long")
    placed, problems = barriers.split_regions(stores, fence, river, ["fence"], "store_id")
    assert {r.store_id: r.piece for r in placed.collect()} == {"W1": "测试河-西", "E1": "测试河-东", "E2": "测试河-东"}
    assert [tuple(r) for r in problems.collect()] == [(1, "no_barrier")]


def test_lines_that_turn_and_end_inside(spark):
    r = np.random.default_rng(4)
    fence = regions(spark, square(0, 0, 100_000, 100_000))
    ys = sorted(r.integers(10_000, 90_000, 30).tolist())
    xs = r.integers(20_000, 80_000, 30).tolist()
    bend = list(zip(xs, ys, strict=True))
    flat = [(y, x) for x, y in bend]
    b = lines(spark, [(0, "n", bend), (0, "e", flat[::-1]), (0, "one", [(5, 5), (5, 5)])])
    pts = r.integers(1, 99_999, (400, 2)).tolist()
    df = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(pts)], "store_id int, x long, y long")
    placed, _ = barriers.split_regions(df, fence, b, ["fence"], "store_id")
    got = {x.store_id: x.piece for x in placed.collect()}

    def right(x, y, bend):
        """Whether x is beyond the line at y; the line goes on straight at its ends."""
        k = min(max(int(np.searchsorted([p[1] for p in bend], y)), 1), len(bend) - 1)
        (x1, y1), (x2, y2) = bend[k - 1], bend[k]
        return x > x1 + (y - y1) / (y2 - y1) * (x2 - x1)

    assert len(got) == 400 and len(set(got.values())) == 4
    for k, (x, y) in enumerate(pts):
        assert got[k] == f"e-{'北' if right(y, x, bend) else '南'}|n-{'东' if right(x, y, bend) else '西'}"


@pytest.mark.parametrize("angle", range(0, 360, 24))
def test_straight_lines_at_every_angle(spark, angle):
    d = (round(1000 * math.cos(math.radians(angle))), round(1000 * math.sin(math.radians(angle))))
    b = lines(spark, [(0, "l", [(5000 - d[0], 5000 - d[1]), (5000, 5000), (5000 + d[0], 5000 + d[1])])])
    pts = np.random.default_rng(angle).integers(1, 9999, (60, 2)).tolist()
    df = spark.createDataFrame([(k, *map(int, p)) for k, p in enumerate(pts)], "store_id int, x long, y long")
    placed, _ = barriers.split_regions(df, regions(spark, square(0, 0, 10_000, 10_000)), b, ["fence"], "store_id")
    east = abs(d[1]) * 110.574 > abs(d[0]) * 102.2
    for r in placed.collect():
        x, y = pts[r.store_id]
        over = (x - 5000) * d[1] - (y - 5000) * d[0]
        toward = over * d[1] > 0 if east else over * d[0] < 0
        assert over == 0 or r.piece == "l-" + (("东" if toward else "西") if east else ("北" if toward else "南"))


def test_shared_borders_of_sloped_and_cut_edges(spark):
    a = [(0, 0), (300_000, 0), (300_000, 200_000), (0, 200_000)]
    b = [(300_000, 50_000), (300_000, 450_000), (400_000, 450_000), (400_000, 50_000)]
    c = [(0, 0), (100_000, -50_000), (300_000, 0)]
    d = [(100_000, -50_000), (40_000, -20_000), (40_000, -90_000)]  # runs along c's first edge for 60 of 100
    rows = [(k, *p, *q) for k, ring in zip("abcd", (a, b, c, d), strict=True) for p, q in zip(ring, [*ring[1:], ring[0]], strict=True)]
    got = {(r.a, r.b): r.metres for r in scores.shared_borders(spark.createDataFrame(rows, "k string, x1 long, y1 long, x2 long, y2 long"), "k").collect()}
    want = {("a", "b"): 150 * 110.574, ("a", "c"): 300 * 102.2, ("c", "d"): math.hypot(60 * 102.2, 30 * 110.574)}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-3 for k, v in want.items())


def test_stretches_are_met_by_the_cells_along_them(spark):
    r = np.random.default_rng(3)
    s = [(k, *map(int, r.integers(0, 1_000_000, 2)), *map(int, r.integers(0, 1_000_000, 2))) for k in range(40)]
    s += [(100, 5, 5, 5, 5), (101, 0, 500_000, 900_000, 500_000), (102, 400_000, 0, 400_000, 900_000), (103, -10**8, -10**8, 10**8, 10**8), (104, 10, 10, 12, 11)]
    p = [(k, *map(int, x)) for k, x in enumerate(r.integers(0, 1_000_000, (200, 2)))] + [(900, 6, 6), (901, 400_001, 3)]
    points, stretches = spark.createDataFrame(p, "k int, x long, y long"), spark.createDataFrame(s, "id int, x1 long, y1 long, x2 long, y2 long")

    def metres(x, y, x1, y1, x2, y2):
        dx, dy, px, py = (x2 - x1) * 0.1022, (y2 - y1) * 0.110574, (x - x1) * 0.1022, (y - y1) * 0.110574
        t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
        return math.hypot(px - t * dx, py - t * dy)

    for reach in (50.0, 3000.0):
        got = [(q.k, q.id) for q in scores.near_segments(points, stretches, reach).collect()]
        want = {(k, i) for k, x, y in p for i, *e in s if metres(x, y, *e) <= reach}
        assert set(got) == want and len(got) == len(want) and want
    assert scores.near_segments(points, stretches.limit(0), 50.0).collect() == []


def test_samples_of_borders(spark):
    ring = spark.createDataFrame([(1, square(0, 0, 1000, 500)), (2, [(k, k * k % 7) for k in range(450)])], f"fence int, ring {RING}")
    one = ring.where("fence = 1")
    mid = scores.ring_samples(one, ["fence"], F.floor(F.col("whole") / 500), middle=True).orderBy("k").collect()
    assert [(r.x, r.y) for r in mid] == [(250, 0), (750, 0), (1000, 250), (750, 500), (250, 500), (0, 250)]
    assert [(r.x, r.y) for r in scores.ring_samples(one, ["fence"], 4).orderBy("k").collect()] == [(0, 0), (750, 0), (1000, 500), (250, 500)]
    assert [r.k for r in scores.vertex_samples(ring.where("fence = 2"), ["fence"], 200).orderBy("k").collect()] == list(range(0, 450, 2))
    kept = [r.k for r in scores.thinned(ring, ["fence"], 200).where("fence = 2").orderBy("k").collect()]
    assert kept == [int(i * 449 / 199) for i in range(200)]
    assert scores.thinned(ring, ["fence"], 200).where("fence = 1").count() == 4
