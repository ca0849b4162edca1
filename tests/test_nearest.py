"""Nearest sites on the sphere and the plane against brute force, and what rests on them, by value."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrane.operators import classify, ownership, spatial  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def arc(a, b):
    lon1, lat1, lon2, lat2 = (math.radians(v / 1e6) for v in (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def flat(a, b):
    return math.hypot((a[0] - b[0]) / 1e6 * 102.2, (a[1] - b[1]) / 1e6 * 110.574)


@pytest.mark.parametrize("case", ["town", "world", "poles", "hot cell"])
def test_nearest_on_the_sphere_equals_brute_force(spark, case):
    r = np.random.default_rng(len(case))
    box = {"town": ((113.0, 114.0), (22.5, 23.5)), "world": ((-180, 180), (-90, 90)), "poles": ((-180, 180), (84, 90)), "hot cell": ((113.0, 113.001), (23.0, 23.001))}[case]
    draw = lambda n: np.stack([r.uniform(*box[0], n), r.uniform(*box[1], n)], 1) * 1e6
    p, s = draw(150).astype(int).tolist(), draw(40).astype(int).tolist()
    s += s[:2] + [[179_999_000, 0], [-179_999_000, 1]] + ([[113_900_000, 23_900_000]] if case == "hot cell" else [])
    p += [[180_000_000, 0], [113_000_000, 89_999_999]]
    points = spark.createDataFrame([(k, *map(int, x)) for k, x in enumerate(p)] + [(999, None, 1)], "store_id int, x long, y long")
    sites = spark.createDataFrame([(k, *map(float, x)) for k, x in enumerate(s)], "dealer_id int, mx double, my double")
    for plane, measure in ((False, arc), (True, flat)):
        got = {x.store_id: (x.dealer_id, x.km) for x in spatial.nearest_km(points, sites, "store_id", "dealer_id", ["dealer_id"], flat=plane).collect()}
        assert set(got) == set(range(len(p)))
        for k, at in enumerate(p):
            best = min(range(len(s)), key=lambda j: (round(measure(at, s[j]), 9), j))
            assert abs(got[k][1] - measure(at, s[best])) < 1e-6, case
            assert got[k][0] == best or abs(measure(at, s[got[k][0]]) - measure(at, s[best])) < 1e-9
    assert spatial.nearest_km(points, sites.limit(0), "store_id", "dealer_id", ["dealer_id"]).collect() == []


def gap_stores(spark):
    """Stores in no fence: without upstream, of a fence's dealer, of another, and one far away; one that is no gap."""
    rows = [("g1", "A", 113_320_000, 23_010_000, None), ("g2", "A", 113_320_000, 23_020_000, "甲"), ("g3", "B", 113_330_000, 23_010_000, "丙"), ("g4", "B", 113_500_000, 23_200_000, "甲"), ("ok", "A", 113_300_000, 23_000_000, "甲")]
    df = spark.createDataFrame(rows, "store_id string, district string, x long, y long, upstream string")
    return df.withColumn("kind", F.when(F.col("store_id") == "ok", "OK").otherwise("GAP"))


def test_gap_classes_and_five_kilometres(spark):
    stores = gap_stores(spark)
    sites = spark.createDataFrame([("甲", 113_310_000.0, 23_010_000.0)], "dealer_id string, mx double, my double")
    near = spatial.nearest_km(stores, sites, "store_id", "dealer_id", ["dealer_id"])
    got = {r.store_id: r for r in classify.gap_classes(stores, near, sites.select("dealer_id")).collect()}
    assert {k: (r["class"], r.layer, r.structural) for k, r in got.items()} == {"g1": ("no_upstream", "DATA", False), "g2": ("dealer_outside", "D", False), "g3": ("other_upstream", "D", False), "g4": ("dealer_outside", "D", True)}
    assert got["g4"].nearest_km > 5 and abs(got["g1"].nearest_km - 1.02) < 0.01
    edge = near.withColumn("km", F.when(F.col("store_id") == "g1", 5.004).otherwise(5.006))
    assert {r.store_id: r.structural for r in classify.gap_classes(stores, edge, sites.select("dealer_id")).collect()} == {"g1": False, "g2": True, "g3": True, "g4": True}
    total = classify.gap_summary(classify.gap_classes(stores, near, sites.select("dealer_id"))).collect()
    assert {(r.layer, r.n) for r in total if r.layer} == {("DATA", 1), ("D", 3)} and max(r.n for r in total) == 4
    assert not any(r.structural for r in classify.gap_classes(stores, near.limit(0), sites.select("dealer_id")).collect())


def test_allocation_takes_the_pooled_centroid(spark):
    vertices = [("a", 1, 0, 0), ("a", 1, 2, 0), ("a", 1, 2, 2), ("a", 1, 0, 2), ("a", 2, 100, 0), ("a", 2, 102, 0), ("a", 2, 102, 2), ("a", 2, 100, 2), ("b", 1, 20, 0), ("b", 1, 22, 0), ("b", 1, 22, 2), ("b", 1, 20, 2)]
    v = spark.createDataFrame(vertices, "dealer_id string, comp int, x long, y long")
    stores = spark.createDataFrame([(1, 5, 1, None, []), (2, 60, 1, None, []), (3, 5, 1, "a", ["b"]), (4, 5, 1, "z", ["b", "a"]), (5, 5, 1, "a", ["a"])], "store_id int, x long, y long, upstream string, dealers array<string>")
    near = spatial.nearest_km(stores, spatial.centroids(v, ["dealer_id"]), "store_id", "dealer_id", ["dealer_id"], flat=True)
    got = {r.store_id: (r.dealer_id, r.rule) for r in ownership.allocate(stores, near, v.select("dealer_id").distinct(), F.col("store_id") == 5).collect()}
    # store 1 lies in a's first component's neighbourhood, but the middle of all of a's vertices is farther than b's
    assert got == {1: ("b", "NEAREST_CENTROID"), 2: ("a", "NEAREST_CENTROID"), 3: ("a", "UPSTREAM"), 4: ("b", "CURRENT_FENCE"), 5: (None, "EXCLUDED")}
