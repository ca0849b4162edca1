"""Exact values and brute force for single operators on small tables."""

from __future__ import annotations

import json
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrane.operators import classify, graph, identity, landmarks, measures, rebuild, rules, scenarios, scores, sizing, spatial  # noqa: E402
from terrane.sources import packs  # noqa: E402
from terrane.streaming import jobs  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def accounts(spark, rows):
    return spark.createDataFrame(rows, "scope long, account_id long, territory_id long, load double")


def greedy(rows, most=5):
    """Moves of one scope, account by account, kept in plain dicts."""
    own, eq = {}, lambda v: 1.0 if len(v) <= 1 or sum(v) <= 0 else sum(v) ** 2 / (len(v) * sum(x * x for x in v))
    for a, t, load in rows:
        own.setdefault(t, {})[a] = load
    out = []
    if sum(sum(v.values()) > 0 for v in own.values()) < 2:
        return out
    for _ in range(most):
        total = {t: sum(v.values()) for t, v in own.items()}
        src, dst = min(total, key=lambda t: (-total[t], t)), min(total, key=lambda t: (total[t], t))
        if src == dst or not own[src]:
            break
        a = min(own[src], key=lambda k: (-own[src][k], k))
        trial = total | {src: total[src] - own[src][a], dst: total[dst] + own[src][a]}
        if eq(list(trial.values())) <= eq(list(total.values())) + 1e-12:
            break
        own[dst][a] = own[src].pop(a)
        out.append((a, src, dst))
    return out


def test_rebalance_equals_a_plain_plan_and_needs_two_loaded_territories(spark):
    assert sizing.rebalance(accounts(spark, [(0, 1, 1, 7.0), (0, 2, 2, 0.0)])).count() == 0
    assert sizing.rebalance(accounts(spark, [(0, 1, 1, 3000.0), (0, 2, 2, 3000.0)])).count() == 0
    first = sizing.rebalance(accounts(spark, [(0, 1, 1, 3000.0), (0, 2, 1, 3000.0), (0, 3, 1, 3000.0), (0, 9, 2, 300.0)])).orderBy("step").collect()
    assert (first[0].account_id, first[0].src, first[0].dst) == (1, 1, 2)
    rng = np.random.default_rng(0)
    rows = [(s, int(a), int(rng.integers(0, 4)), float(rng.integers(0, 50))) for s in range(12) for a in rng.permutation(40)[:25]]
    got = {}
    for r in sizing.rebalance(accounts(spark, rows)).orderBy("scope", "step").collect():
        got.setdefault(r.scope, []).append((r.account_id, r.src, r.dst))
    assert got == {s: m for s in range(12) if (m := greedy([r[1:] for r in rows if r[0] == s]))}


def test_sizing_values(spark):
    load = spark.createDataFrame([(1, 100, 30), (1, 100, 30), (2, 300, 30)], "territory_id long, calls long, minutes long")
    assert {r.territory_id: r.load for r in sizing.loads(load).collect()} == {1: 6000, 2: 9000}
    b = sizing.balance(sizing.loads(load), 72000.0).first()
    assert (b.reps_by_territory, b.reps_on_total, b.max_min) == (2, 1, 1.5)
    reps = spark.createDataFrame([(200_000,), (0,), (72_000,), (72_001,)], "m long").select(sizing.required_reps(F.col("m"), 72000.0).alias("r"))
    assert [r.r for r in reps.collect()] == [3, 0, 1, 2]
    for values, eq in (([100, 100], 1.0), ([100, 0], 0.5), ([3, 1, 1, 1], 0.75), ([5], 1.0)):
        assert sizing.eq_index(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "territory_id long, load long")).first().eq == eq
    sites = spark.createDataFrame([(0, 0.0, 0.0, 0), (2, 2.0, 0.0, 5), (1, 1.0, 0.0, 3), (3, 0.5, 0.0, 0), (9, 1.0, 0.0, 2)], "territory_id long, x_km double, y_km double, headroom long")
    assert [(r.near_id, r.distance) for r in sizing.nearby(sites, 25.0, 3).where("territory_id = 0").orderBy("rank").collect()] == [(1, 1.0), (9, 1.0), (2, 2.0)]


def test_half_words_and_district_names(spark):
    asked = ["东", "南边", "西部", "北侧", "东半区", "东部片区", "北部区域", "西北", None]
    got = [r.h for r in spark.createDataFrame([(a,) for a in asked], "s string").select(scenarios.half(F.col("s")).alias("h")).collect()]
    assert got == ["east", "south", "west", "north", "east", None, None, None, None]
    sets = spark.createDataFrame([(1, 1), (1, 2)], "dealer_id long, unit_id long")
    units = spark.createDataFrame([(1, 0, 0, "甲街", "越秀"), (2, 9, 0, "乙街", "天河区")], "unit_id long, x long, y long, street string, district string")
    p = spark.createDataFrame([(k, 1, 2, s) for k, s in enumerate(["越秀区", "天河区", "甲街", "东", "OOF", "哪里"])], "proposal_id long, src long, dst long, selector string")
    picked, verdicts = scenarios.select_units(p, sets, units)
    assert {(r.proposal_id, r.unit_id) for r in picked.collect()} == {(0, 1), (1, 2), (2, 1), (3, 2)}
    assert {r.proposal_id: r.reason for r in verdicts.collect()} == {0: "district", 1: "district", 2: "street", 3: "half", 4: "not_an_area", 5: "unknown"}


def test_routes(spark):
    cases = {"CapacityShortage": "DP01 Resource Sizing", "ResourceLocationMismatch": "DP02 Resource Location", "TerritoryImbalance": "DP03 Territory Alignment", "PersonnelConstraint": "DP04 Personnel Matching", "CoverageAllocationMismatch": "DP05 Coverage Allocation", "SchedulingInfeasibility": "DP06 Visit Scheduling", "RoutingInefficiency": "DP07 Daily Routing", "DataQualityIssue": "World Model Repair", "IdentityDuplicate": "World Model Repair", "IdentityUnresolved": "World Model Repair"}
    rows = [(d, None) for d in [*cases, "NoGap", "完全未知的诊断", None]] + [("CapacityShortage", 0.2), ("IdentityDuplicate", 0.2)]
    got = rules.route(spark.createDataFrame(rows, "diagnosis string, unresolved double")).collect()
    assert [(r.output, r.route) for r in got[: len(cases)]] == [("Route", v) for v in cases.values()]
    assert [(r.output, r.route) for r in got[len(cases) : len(cases) + 3]] == [("NoAction", None), ("RequestMoreEvidence", None), ("RequestMoreEvidence", None)]
    assert [r.alternative for r in got[-2:]] == ["World Model Repair", None]


def test_gap_problems_and_policies(spark):
    rows = [("g", "CapacityGap", "CapacityLocalGap", 140.0, 100.0, None, 0.6, 0.9), ("g", "CoverageGap", "CapacityLocalGap", 1.0, 1.0, 5.0, 0.6, 0.9), ("g", "CoverageGap", "IdentityDuplicate", 1.0, 1.0, None, 0.6, 0.9), ("", "CoverageGap", None, 1.0, 1.0, None, 0.6, 0.9), ("g", "CoverageGap", "Other", 1.0, 1.0, None, 1.6, 0.9), ("g", "CoverageGap", "Other", 1.0, 1.0, None, 0.6, None)]
    got = rules.normalised(spark.createDataFrame(rows, "gap_id string, gap_type string, subtype string, observed double, reference double, gap_value double, severity double, confidence double")).collect()
    assert [(r.gap_value, r.problem) for r in got] == [(40.0, None), (5.0, "subtype_of_other_type"), (0.0, None), (0.0, "no_id"), (0.0, "severity"), (0.0, "confidence")]
    p = rules.trigger_policy(spark.createDataFrame([(0.3, None, 0.6), (0.3, 0.4, 0.6), (0.3, 0.1, 1.6)], "entry double, exit double, confidence_gate double")).collect()
    assert [(r.exit, r.problem) for r in p] == [(0.15, None), (0.4, "exit_above_entry"), (0.1, "confidence_gate")]


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    p = [(k, int(k % 3), int(x), int(y)) for k, (x, y) in enumerate(np.concatenate([rng.integers(0, 1000, (150, 2)), rng.integers(0, 10**6, (60, 2))]))] + [(999, 1, None, 3)]
    s = [(k, int(k % 2), int(x), int(y)) for k, (x, y) in enumerate(np.concatenate([rng.integers(0, 1000, (40, 2)), [[900_000, 900_000], [500, 500], [500, 500]]]))]
    points = spark.createDataFrame(p, "key long, g long, x long, y long")
    sites = spark.createDataFrame(s, "site long, g long, mx long, my long")
    far = lambda a, b: (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2
    got = {r.key: r.site for r in spatial.nearest(points, sites.drop("g"), "key", "site", ["site"]).collect()}
    assert got == {a[0]: min(s, key=lambda b: (far(a, b), b[0]))[0] for a in p if a[2] is not None}
    got = {r.key: r.site for r in spatial.nearest(points, sites, "key", "site", ["site"], by=("g",)).collect()}
    assert got == {a[0]: min((b for b in s if b[1] == a[1]), key=lambda b: (far(a, b), b[0]))[0] for a in p if a[2] is not None and a[1] < 2}
    assert spatial.nearest(points, sites.limit(0), "key", "site", ["site"]).count() == 0


def test_rings_of_touching_cells_and_holes(spark):
    cells = [(1, 0, 0), (1, 1, 1)] + [(2, i, j) for i in range(3) for j in range(3) if (i, j) != (1, 1)]
    got = graph.rings(spark.createDataFrame(cells, "dealer_id long, i long, j long"), "dealer_id", 0.5).collect()
    assert sorted((r.edges, r.doubled) for r in got if r.dealer_id == 1) == [(4, 2), (4, 2)]
    assert sorted((r.edges, r.doubled, len(r.points)) for r in got if r.dealer_id == 2) == [(4, -2, 4), (12, 18, 5)]
    assert graph.simplified([(0, 0), (1, 0.1), (2, 0), (3, 5), (4, 0)], 1.0) == [(0, 0), (2, 0), (3, 5), (4, 0)]


def test_hull_holds_all_points_and_turns_left(spark):
    rng = np.random.default_rng(2)
    p = [(k % 2, float(x), float(y)) for k, (x, y) in enumerate(rng.normal(0, 1, (400, 2)).round(3))] + [(7, 1.0, 1.0), (7, 1.0, 1.0)]
    hull = {}
    for r in graph.hulls(spark.createDataFrame(p, "key long, x double, y double"), "key", 8).orderBy("key", "pos").collect():
        hull.setdefault(r.key, []).append((r.x, r.y))
    assert hull[7] == [(1.0, 1.0)]
    for key in (0, 1):
        ring = hull[key]
        for (ax, ay), (bx, by) in zip(ring, [*ring[1:], ring[0]], strict=True):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= -1e-12 for k, x, y in p if k == key)


def test_compact_terms_take_the_largest_gain_first(spark):
    truth = spark.createDataFrame([(1, u) for u in range(10)], "dealer_id long, unit_id long")
    terms = {"a": range(0, 6), "b": range(4, 12), "c": [6, 7], "d": [8, 9, 20, 21]}
    rows = [(t, int(u)) for t, v in terms.items() for u in v]
    got = [(r.term, r.gain) for r in graph.compact_terms(truth, spark.createDataFrame(rows, "term string, unit_id long")).orderBy("n").collect()]
    assert got == [("a", 6), ("b", 2)]


def test_flood_stops_at_walls_and_hops(spark):
    edges = spark.createDataFrame([(0, k, k + 1) for k in range(9) if k != 6], "k long, a long, b long")
    got = {r.unit_id: r.hop for r in graph.flood(spark.createDataFrame([(0, 2)], "k long, unit_id long"), edges, ["k"], 3).collect()}
    assert got == {2: 0, 1: 1, 3: 1, 0: 2, 4: 2, 5: 3}


def test_clusters_with_different_contacts_stay_apart(spark):
    r = spark.createDataFrame([(1, 5), (2, 5), (3, None), (4, 7), (5, 8)], "record_id long, contact long")
    m = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a long, b long")
    got = {x.record_id: (x.cluster, x.conflict) for x in identity.clusters(r, m).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (3, True), 4: (4, True), 5: (5, False)}
    got = {x.record_id: x.cluster for x in identity.clusters(r, m.where("a < 3")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_as_of_sees_nothing_that_was_recorded_later(spark):
    v = spark.createDataFrame([(1, 10, 1, 1, "a"), (1, 11, 2, 9, "b"), (1, 12, 5, 5, "c")], "key long, version long, valid_from long, recorded long, value string")
    asked = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (2, 1, 4), (3, 1, 8), (4, 1, 20), (5, 2, 20)], "ask_id long, key long, at long")
    assert {r.ask_id: r.value for r in identity.as_of(v, asked, "key", "value").collect()} == {0: None, 1: "a", 2: "a", 3: "c", 4: "c", 5: None}


def test_roll_up_counts_a_node_with_two_parents_once(spark):
    nodes = spark.createDataFrame([("x", "p"), ("x", "q"), ("y", "p"), ("p", "top"), ("q", "top"), ("top", None)], "node string, parent string")
    got = {r.ancestor: (r.members, r.total) for r in measures.rolled_up(spark.createDataFrame([("x", 3), ("y", 4)], "node string, value long"), measures.ancestors(nodes)).collect()}
    assert got == {"x": (1, 3), "y": (1, 4), "p": (2, 7), "q": (1, 3), "top": (2, 7)}


def test_ring_stitching_and_classes_of_an_extract(spark, tmp_path):
    pt = lambda *xy: [{"lon": float(x), "lat": float(y)} for x, y in xy]
    way = lambda role, *xy: {"type": "way", "role": role, "geometry": pt(*xy)}
    elements = [
        {"type": "way", "id": 1, "tags": {"name": "河", "waterway": "canal", "highway": "primary", "ref": "G4"}, "geometry": pt((0, 0), (1, 1))},
        {"type": "way", "id": 2, "tags": {"highway": "trunk", "ref": "G5"}, "geometry": pt((0, 0), (1, 1), (2, 2))},
        {"type": "way", "id": 3, "tags": {"name": "点", "highway": "trunk"}, "geometry": pt((0, 0))},
        {"type": "relation", "id": 4, "tags": {"name": "区", "boundary": "administrative", "admin_level": "8"}, "members": [way("outer", (0, 0), (1, 0)), way("inner", (9, 9), (8, 8)), way("", (1, 0), (1, 1), (0, 0)), way("outer", (5, 5), (6, 5)), way("outer", (7, 7), (8, 7), (8, 8), (7, 7))]},
    ]
    (tmp_path / "map.json").write_text(json.dumps({"elements": elements}, indent=1))
    lines = {(r["class"], r.name_, r.n) for r in packs.landmark_lines(spark, str(tmp_path)).select("class", F.col("name").alias("name_"), F.size("points").alias("n")).collect()}
    assert {x for x in lines if x[0] != "district"} == {("river", "河", 2), ("road", "河", 2), ("ref", "G4", 2), ("ref", "G5", 3)}
    assert [(r.ring, r.n) for r in packs.stitched(spark, str(tmp_path)).select("ring", F.size("points").alias("n")).orderBy("ring").collect()] == [(0, 4), (1, 4)]


def test_shifted_points_come_back(spark):
    df = spark.createDataFrame([(113.2644, 23.1291, "GCJ-02"), (113.2644, 23.1291, "WGS84"), (113.2644, 23.1291, None)], "lon double, lat double, crs string").withColumn("s", packs.is_shifted(F.col("crs")))
    lon, lat = packs.to_wgs(F.col("lon"), F.col("lat"), F.col("s"))
    moved = df.withColumns({"a": lon, "b": lat})
    back = moved.select("a", "b", *(c.alias(n) for c, n in zip(packs.from_wgs(F.col("a"), F.col("b"), F.col("s")), ("x", "y"), strict=True))).collect()
    assert (back[1].a, back[1].b) == (113.2644, 23.1291) and abs(back[0].a - 113.2644) > 1e-3 and back[0][:2] == back[2][:2]
    assert all(abs(r.x - 113.2644) < 2e-5 and abs(r.y - 23.1291) < 2e-5 for r in back)


def test_name_costs_and_ring_roads(spark):
    pairs = [("广园快速路", "广园快速", 0.05), ("广园快速路", "广园东", 0.5), ("广园", "天河", 1.0), ("", "天河", 1.0), (None, "x", 1.0)]
    got = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(landmarks.name_cost(F.col("a"), F.col("b")).alias("c")).collect()
    assert [r.c for r in got] == [p[2] for p in pairs]
    rows = [("环城", 0, 0, 0), ("直", 0, 0, 0), ("直", 1, 9, 0)] + [("圈", k, *p) for k, p in enumerate([(0, 0), (5, 0), (9, 0), (9, 5), (9, 9), (5, 9), (0, 9), (0, 5), (0, 0)])]
    assert {r["name"] for r in landmarks.closed(spark.createDataFrame(rows, "name string, pos long, x long, y long")).where("ring").collect()} == {"环城", "圈"}


def test_region_on_the_wrong_side_is_left_as_it_is(spark):
    ring = spark.sql("SELECT 1L AS id, array(named_struct('x', 0D, 'y', 0D), named_struct('x', 10D, 'y', 0D), named_struct('x', 10D, 'y', 10D), named_struct('x', 0D, 'y', 10D)) AS ring")
    cuts = spark.createDataFrame([(1, "北", 0.0, 6.0, 0.0, 1.0), (1, "南", 0.0, 20.0, 0.0, 1.0), (1, "东", 30.0, 0.0, 1.0, 0.0)], "id long, side string, px double, py double, nx double, ny double")
    rings, notes = rebuild.clip_by_bounds(ring, cuts)
    assert {r.side: r.note for r in notes.collect()} == {"北": "cut", "南": "outside", "东": "inside"}
    assert sorted((p.x, p.y) for p in rings.first().ring) == [(0.0, 0.0), (0.0, 6.0), (10.0, 0.0), (10.0, 6.0)]


def test_quantiles_of_ties(spark):
    rng = np.random.default_rng(5)
    v = {k: sorted(rng.integers(0, 30, n).tolist()) for k, n in ((0, 1), (1, 10), (2, 1001))}
    df = spark.createDataFrame([(k, float(x)) for k, own in v.items() for x in own], "k long, v double")
    got = {r.k: (r.a, r.b, r.c) for r in scores.quantiles(df, "k", "v", {"a": 0.0, "b": 0.5, "c": 0.9}, 4.0).collect()}
    assert got == {k: tuple(float(own[int((len(own) - 1) * p)]) for p in (0.0, 0.5, 0.9)) for k, own in v.items()}


def test_changelog_goes_on_after_a_restart(spark, tmp_path):
    write = lambda rows: spark.createDataFrame(rows, "unit_id long, seq long, owner long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("unit_id long, seq long, owner long").parquet(f"{tmp_path}/in")
    write([(1, 1, 5), (1, 2, 6), (2, 1, 5)])
    jobs.changelog(stream(), "log", f"{tmp_path}/base")
    write([(1, 3, 7), (3, 1, 9)])
    assert {r.unit_id: r.owner for r in jobs.changelog(stream(), "log", f"{tmp_path}/base").collect()} == {1: 7, 2: 5, 3: 9}
    assert {r.unit_id: r.owner for r in jobs.changelog(stream(), "log", f"{tmp_path}/base").collect()} == {1: 7, 2: 5, 3: 9}


def test_health_lines(spark):
    rows = [(k, [1], kind) for k, kind in enumerate(["OK"] * 7 + ["OOF"] * 3)] + [(20 + k, [2], kind) for k, kind in enumerate(["OK"] * 7 + ["OOF"] * 2 + ["DIRECT_IN"])] + [(40, [3], "OK")]
    area = spark.createDataFrame([(1, 10.0), (2, 10.0), (3, 22.0), (4, 1.0)], "dealer_id long, area_km2 double")
    got = {r.dealer_id: r for r in classify.health(spark.createDataFrame(rows, "store_id long, dealers array<long>, kind string"), area).collect()}
    assert [got[k].verdict for k in (1, 2, 3, 4)] == ["调查", "观察", "健康", "观察"]
    assert (got[1].oof_rate, got[2].ok_rate, got[2].oof_rate, got[4].density) == (0.3, 0.7, 0.2, 0.0)
