"""What large tables asked for: plans and operators that keep their results while their work stays in bounds."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrane import bindings as B  # noqa: E402
from terrane import catalog  # noqa: E402
from terrane.llm import near_copies  # noqa: E402
from terrane.operators import graph, identity, scenarios, scores, sizing, spatial  # noqa: E402
from terrane.plans import landmarks, rebuilt  # noqa: E402
from terrane.plans import scenarios as scenario_plans  # noqa: E402
from terrane.plans import scores as score_plans  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "2g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_no_join_broadcasts_by_estimate(spark):
    """An exploded side that a small file's size hides is not planned as a broadcast."""
    df = catalog.queries()["j11_unit_shares"](spark, SF)
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().sparkPlan().toString()


def test_records_of_one_source_never_meet(spark):
    """60,000 records of one source in one block, and two pairs that share one or both keys."""
    rows_ = spark.range(60_000).selectExpr("id + 100 AS record_id", "'b' AS source", "-1L AS contact", "concat('n', id) AS name")
    few = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", 5, "x"), (3, "a", None, "y"), (4, "b", 7, "y")], "record_id long, source string, contact long, name string")
    began = time.time()
    got = identity.candidates(rows_.unionByName(few), {"contact": F.col("contact"), "name": F.col("name")})
    assert rows(got) == [(1, 2), (3, 4)]
    assert time.time() - began < 60  # 3.6e9 pairs were made and dropped


def test_stretches_by_descending_boxes(spark):
    """The class of the nearest stretch and the nearest stretches are those of all pairs."""
    rng = np.random.default_rng(3)
    ends = rng.integers(0, 400_000, (300, 4)).tolist() + [[5, 5, 5, 5]]
    stretches = spark.createDataFrame([(k, f"n{k % 3}", *map(int, e)) for k, e in enumerate(ends)], "pos long, name string, x1 long, y1 long, x2 long, y2 long")
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(rng.integers(-60_000, 460_000, (400, 2)).tolist() + [[5, 5]])], "k long, x double, y double")
    pairs = {}
    for p in scores.near_segments(points, stretches, 3000.0).collect():
        pairs.setdefault(p.k, []).append((round(p.m, 4), p.name, p.pos))
    reached = {r.k: r.reached for r in scores.reach_class(points, ["k"], stretches, [1000.0, 3000.0]).collect()}
    assert reached == {k: min((0 if m <= 1000 else 1 for m, *_ in pairs.get(k, [])), default=2) for k in range(401)}
    got = {}
    for p in scores.nearest_stretches(points, ["k"], stretches, ["name", "pos"], 5, 3000.0).collect():
        got.setdefault(p.k, []).append((round(p.m, 4), p.name, p.pos))
    assert {k: sorted(v)[:5] for k, v in got.items()} == {k: sorted(v)[:5] for k, v in pairs.items()}
    assert {r.reached for r in scores.reach_class(points, ["k"], stretches.limit(0), [50.0]).collect()} == {1}


def test_nearest_within_a_radius_is_that_of_all_pairs(spark):
    """Also with ties, crowds and points that nothing is near."""
    rng = np.random.default_rng(5)
    at = rng.integers(0, 40, (600, 2)) * 1000
    sites = spark.createDataFrame([(f"s{k % 7}", int(x), int(y)) for k, (x, y) in enumerate(at)], "name string, mx long, my long")
    points = spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate(rng.integers(-40, 80, (300, 2)) * 1000)], "k long, x long, y long")
    want = spatial.within(points, sites, 1.5).groupBy("k").agg(F.min_by("name", F.struct("d2", "name")).alias("name"))
    assert rows(spatial.nearest_within(points, sites, "k", "name", 1.5).select("k", "name")) == rows(want)
    assert rows(spatial.nearest_within(points, sites.limit(0), "k", "name", 1.5)) == []


def test_neighbours_of_a_crowd(spark):
    """20,000 sites within each other's radius, of which every third has room."""
    rng = np.random.default_rng(7)
    at = rng.random((20_000, 2)) * 10
    at[:2] = 9_000.0, 9_000.5
    sites = spark.createDataFrame([(k, float(x), float(y), int(k % 3 == 0)) for k, (x, y) in enumerate(at)], "territory_id long, x_km double, y_km double, headroom int")
    began = time.time()
    got = {}
    for r in sizing.nearby(sites, 20.0, 3).orderBy("rank").collect():
        got.setdefault(r.territory_id, []).append((r.distance, r.near_id))
    assert time.time() - began < 90  # 1.3e8 pairs were ranked
    free = np.arange(0, 20_000, 3)
    for k in (0, 1, 2, 500, 19_999):
        d = np.hypot(*(at[free] - at[k]).T)
        assert got.get(k, []) == sorted((round(float(v), 4), int(f)) for v, f in zip(d, free, strict=True) if f != k and v <= 20)[:3]


def test_equal_terms_are_resolved_once(spark):
    """5,000 times a street along a road of 50,000 units."""
    units = spark.range(50_000).selectExpr("2 AS kind_rank", "'R' AS name", "id AS unit_id").unionByName(spark.createDataFrame([(1, "S", 7), (1, "S", 60_000), (3, "S", 8)], "kind_rank int, name string, unit_id long"))
    terms = spark.range(5_000).selectExpr("id AS term_id", "'S 沿 R' AS term").unionByName(spark.createDataFrame([(9_000, "S沿无"), (9_001, "无"), (9_002, "S")], "term_id long, term string"))
    began = time.time()
    got = scenarios.resolve_terms(terms, units).groupBy("term_id").agg(F.sort_array(F.collect_list("unit_id")).alias("u")).collect()
    assert time.time() - began < 60
    assert {r.term_id: r.u for r in got} == {k: [7] for k in range(5_000)} | {9_000: [7, 60_000], 9_002: [7, 60_000]}


def test_broken_lines_meet_vertices_by_place(spark):
    """No filter on places follows a join of whole lines."""
    plan = landmarks.broken_lines(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert any("Join Inner" in line and "place" in line and ">=" not in line.split("Join Inner")[1] for line in plan.splitlines())


def test_ranks_of_distances(spark):
    """Ranks over all points of a centre's lines are those of the sorted distances (F16)."""
    rng = np.random.default_rng(9)
    points = spark.createDataFrame([(f"n{k % 3}", int(x), int(y)) for k, (x, y) in enumerate(rng.integers(0, 10**6, (301, 2)))], "name string, x long, y long")
    centres = spark.createDataFrame([(k, int(x), int(y), ["n0", "n1"] if k % 2 else ["n2"]) for k, (x, y) in enumerate(rng.integers(0, 10**6, (40, 2)))], "dealer_id long, cx long, cy long, lines array<string>")
    km = spatial.km2(F.col("x"), F.col("y"), F.col("cx"), F.col("cy"))
    want = {}
    for r in centres.withColumn("name", F.explode("lines")).join(points, "name").select("dealer_id", F.sqrt(km).alias("km")).collect():
        want.setdefault(r.dealer_id, []).append(r.km)
    for r in scores.distance_ranks(centres, "lines", points, "name", "dealer_id", [0.95, 0.5], chunk=7).collect():
        v = sorted(want.pop(r.dealer_id))
        assert [r.p0, r.p1] == pytest.approx([v[int(len(v) * 0.95)], v[len(v) // 2]], abs=1e-9)
    assert not want


def test_forty_samples_of_a_street(spark):
    """A street's share counts forty points of its border."""
    got = score_plans.street_coverage(spark, SF).select("share").collect()
    assert got and all(abs(r.share * 40 - round(r.share * 40)) < 1e-6 for r in got) and any(round(r.share * 40) % 2 for r in got)


def test_contracts_of_the_same_words_are_drawn_once(spark, monkeypatch):
    """Of 70 dealers, whose contracts have 25 sets of names and some gaps, only the first of each kind is drawn."""
    seen = []
    real = rebuilt.R.from_bounds
    monkeypatch.setattr(rebuilt.R, "from_bounds", lambda c, lines: (seen.append(c.select("id").distinct().count()), real(c, lines))[1])
    one = rebuilt.contracts(spark, SF)
    monkeypatch.setattr(rebuilt, "contracts", lambda s, d: one.unionByName(one.withColumn("id", F.col("id") + 1000)))
    got = {r.id: tuple(r)[1:] for r in rebuilt.from_bounds(spark, SF).collect()}
    n = one.select("id").distinct().count()
    assert seen[0] <= n and len(got) == 2 * n and all(got[k] == got[k + 1000] for k in got if k < 1000)


def test_many_small_groups_share_batches(spark):
    """Hulls and rings of 3,000 keys of a few points each."""
    points = spark.range(3_000).withColumn("p", F.explode(F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (1, 1), (0, 2), (2, 2)))))).select("id", "p.x", "p.y")
    began = time.time()
    assert {r.n for r in graph.hulls(points, "id").groupBy("id").agg(F.count("*").alias("n")).collect()} == {4}
    cells = spark.range(3_000).withColumn("i", F.explode(F.array(F.lit(0), F.lit(5), F.lit(6)))).select("id", "i", F.lit(0).alias("j"))
    got = graph.rings(cells, "id", 0.0).groupBy("edges", "doubled").agg(F.count("*").alias("n")).collect()
    assert {(r.edges, r.doubled): r.n for r in got} == {(4, 2): 3_000, (6, 4): 3_000}
    assert time.time() - began < 60


def test_windows_are_flooded_without_rounds(spark):
    """A winding corridor is flooded as by a plain walk; the query's jobs don't grow with the way's length (F2)."""
    side = 13
    wall = {(i, j) for i in range(1, side, 2) for j in range(side) if j != (side - 1 if i % 4 == 1 else 0)}
    free = [(k, i * side + j, i, j) for k in (1, 2) for i in range(side) for j in range(side) if (i, j) not in wall and not (k == 2 and (i, j) == (4, 6))]
    cells = spark.createDataFrame(free, "key long, unit_id long, i long, j long")
    windows = cells.groupBy("key").agg(F.min("unit_id").alias("seed"), F.collect_list("unit_id").alias("free"))
    way = set()
    for k in (1, 2):
        todo = [(0, 0)]
        while todo:
            i, j = todo.pop()
            if (k, i * side + j, i, j) in free and (k, i * side + j) not in way:
                way.add((k, i * side + j))
                todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
    assert rows(graph.flood_windows(windows, "key", side)) == sorted(way, key=repr) and len(way) < len(free)
    assert rows(graph.flood_windows(windows.withColumn("seed", F.lit(side)), "key", side)) == []  # a seed in a wall
    spark.sparkContext.setJobGroup("g3", "g3")
    catalog.queries()["g3_grid_flood"](spark, SF).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("g3"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 40


def test_rings_of_districts_are_not_made_for_every_store(spark):
    """What reads the squares of districts reads one row for each, so no filter on a ring reaches the stores below."""
    assert "customer.parquet" not in landmarks.district_squares(spark, SF)._jdf.queryExecution().toString()
    assert landmarks.district_squares(spark, SF).count() == B.units(spark, SF).select("district").distinct().count()


def test_rounds_leave_no_shuffle_files(spark):
    """Looking for near copies lets shuffles go with their actions; a task's share of one is bounded (pipeline, F27 to F32)."""
    near_copies.groups(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string"))
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"
    catalog.queries()["j2_dealer_index"](spark, SF)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


def test_crowds_at_one_place_are_searched_for_once(spark, monkeypatch):
    """30 places of 2,000 sites and 1,000 points each: the pairs compared are those of places, not of rows, also within groups."""
    met, kept = [], spatial.stored

    def counted(df, name):
        out = kept(df, name)
        met.append((name, out.count()))
        return out

    monkeypatch.setattr(spatial, "stored", counted)
    at = lambda x, y: (f"113000000L + (id % 30) * 20011L AS {x}", f"22500000L + (id % 30) * (id % 30) * 701L AS {y}")
    sites = spark.range(60_000).selectExpr("59999L - id AS site", "id % 2 AS g", *at("mx", "my"))
    points = spark.range(30_000).selectExpr("id AS k", "id % 2 AS g", *at("x", "y"))
    for by in ((), ("g",)):
        met.clear()
        got = spatial.nearest_km(points, sites, "k", "site", ["site"], by=by)
        assert got.where("site = 29 - k % 30 AND km = 0").count() == got.count() == 30_000
        assert {n for name, n in met if name in ("sites", "places")} == {30}
    met.clear()
    far = points.withColumn("y", F.col("y") + 1_000)
    want = spatial.nearest_km(far.where("k < 30"), sites.where("site < 30"), "k", "site", ["site"]).select((F.col("k") % 30).alias("p"), "site", F.round("km", 9).alias("km"))
    assert rows(spatial.nearest_km(far, sites, "k", "site", ["site"]).select((F.col("k") % 30).alias("p"), "site", F.round("km", 9).alias("km")).distinct()) == rows(want)
    monkeypatch.setattr(spatial, "PAIRS", 7)  # many tasks, same answers
    assert rows(spatial.nearest_km(far.where("k < 30"), sites, "k", "site", ["site"]).select((F.col("k") % 30).alias("p"), "site", F.round("km", 9).alias("km"))) == rows(want)


def test_a_barrier_flood_needs_no_rounds(spark):
    """Windows are flooded as one row each, with the hops of a breadth-first search."""
    free = [(0, 0), (0, 1), (1, 1), (2, 1), (2, 2), (2, 0), (0, 2)]
    windows = spark.createDataFrame([(1, 0, [i * 3 + j for i, j in free]), (2, 0, [0, 8]), (3, 0, [1])], "key long, seed long, free array<long>")
    assert rows(graph.flood_windows(windows, "key", 3, 3)) == [(1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 4, 2), (1, 7, 3), (2, 0, 0)]
    spark.sparkContext.setJobGroup("g2", "g2")
    catalog.queries()["g2_barrier_flood"](spark, SF).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("g2"))
    spark.sparkContext.setJobGroup("", "")
    assert jobs < 30


def test_generated_fences_count_their_stores_by_cell(spark, monkeypatch):
    """15,000 dealers whose fences hold the same 14,634 stores each: pairs are counted, not made (F1)."""
    n, kept = 15_000, 15_000 - len(range(0, 15_000, 41))
    known = spark.range(n).selectExpr("id AS store_id", "113000000L + id % 50000 AS x", "22500000L + id * 7 % 50000 AS y", "id AS upstream", "array(id) AS dealers")
    monkeypatch.setattr(scenario_plans.P, "kinded", lambda s, d: known)
    monkeypatch.setattr(scenario_plans.B, "dealers", lambda s, d: spark.range(n).selectExpr("id AS dealer_id"))
    corners = ", ".join(f"struct(x + {i} AS x, y + {j} AS y)" for i, j in ((0, 0), (1, 0), (1, 1), (0, 1)))
    monkeypatch.setattr(scenario_plans.B, "fences", lambda s, d: known.selectExpr("store_id AS dealer_id", "1 AS comp", f"array({corners}) AS ring"))
    began = time.time()
    got = {r[0]: tuple(r)[1:] for r in scenario_plans.compared(spark, SF).collect()}
    assert time.time() - began < 60  # 220 million pairs were made
    assert got == {k: (int(k % 41 > 0), kept, kept - int(k % 41 > 0), None) for k in range(n)} | {None: (kept, n * kept, n * kept - kept, float(n - 1))}


def test_filled_cells_are_those_that_rings_hold(spark):
    """Cells and holes as by rings and the even-odd test; cells that meet at a corner don't close a hole; stores counted by cell as by pairs (F1)."""
    rng = np.random.default_rng(5)
    shapes = {k: {(int(i), int(j)) for i, j in rng.integers(0, 12, (n, 2))} for k, n in enumerate((1, 30, 90, 140, 250))}
    shapes |= {7: {(i, j) for i in range(12) for j in range(12) if i in (0, 11) or j in (0, 11)} | {(5, 5)}, 8: {(1, 0), (0, 1), (2, 1), (1, 2)}, 9: {(i, j) for i in range(3) for j in range(3)} - {(1, 1)}}
    cells = spark.createDataFrame([(k, i - 4, j + 3) for k, own in shapes.items() for i, j in own] + [(9, None, 3), (9, -4, 3)], "dealer_id long, i long, j long")
    got = rows(graph.filled(cells, "dealer_id", (-4, 3), 12))
    ring = F.transform("points", lambda p: F.struct(p["x"].cast("long").alias("x"), p["y"].cast("long").alias("y")))
    outer = graph.rings(cells.dropna(), "dealer_id", 0.0).where("doubled > 0").select("dealer_id", ring.alias("ring"))
    grid = spark.range(400).selectExpr("id AS store_id", "id div 20 - 8 AS x", "id % 20 - 1 AS y")
    held = spatial.contain(grid, outer, ["dealer_id"]).distinct()
    assert got == rows(held.select("dealer_id", "x", "y")) and len(got) > sum(map(len, shapes.values()))
    with pytest.raises(Exception, match="outside the square"):
        graph.filled(cells, "dealer_id", (-4, 3), 11).count()
    stores = grid.selectExpr("store_id", "x AS i", "y AS j")
    stores = stores.unionByName(stores.selectExpr("store_id + 1000 AS store_id", "i", "j").where("i > 0")).unionByName(stores.where("j = 9"))
    now = stores.join(spark.range(12).selectExpr("id AS dealer_id"), F.expr("(store_id * 7 + dealer_id) % 5 = 0"))
    made = graph.filled(cells, "dealer_id", (-4, 3), 12)
    assert rows(scenarios.compare_cells(now, made, stores)) == rows(scenarios.compare(now.select("dealer_id", "store_id"), made.join(stores, ["i", "j"]).select("dealer_id", "store_id")))
