"""Exact values of single operators, and every query with SQL against DuckDB on a small scale."""

from __future__ import annotations

import math
import os
import sys
from collections import Counter
from datetime import date
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrane import bindings, catalog  # noqa: E402
from terrane.operators import classify, ownership, sizing, spatial  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(values):
    cell = lambda v: "∅" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(v) for v in r) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(SF).iterdir():
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    rel = con.sql(catalog.oracle_sql()[name])
    got = catalog.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    order = [rel.columns.index(c) for c in got.columns]
    assert rows(got.collect()) == rows([r[k] for k in order] for r in rel.fetchall())


def test_point_on_edges_of_a_square(spark):
    ring = spark.sql("SELECT 1L AS dealer_id, array(named_struct('x', 0L, 'y', 0L), named_struct('x', 10L, 'y', 0L), named_struct('x', 10L, 'y', 10L), named_struct('x', 0L, 'y', 10L)) AS ring")
    points = spark.createDataFrame([(1, 5, 5), (2, 0, 0), (3, 10, 5), (4, 5, 10), (5, None, 3)], "store_id long, x long, y long")
    assert sorted(r.store_id for r in spatial.contain(points, ring, ["dealer_id"]).collect()) == [1, 2]


def test_kinds(spark):
    df = spark.createDataFrame([([1, 2], False, 1), ([], True, 1), ([], False, None), ([1], True, 2), ([1], False, 1), ([1], False, None)], "dealers array<long>, direct boolean, upstream long")
    assert [r.k for r in df.select(classify.kind(F.col("dealers"), F.col("direct"), F.col("upstream")).alias("k")).collect()] == ["MULTI", "DIRECT", "GAP", "DIRECT_IN", "OK", "OOF"]


def test_most_specific_rule_and_largest_node_win(spark):
    stores = spark.createDataFrame([(1, 1, 1, "a"), (2, 9, 9, "b")], "store_id long, province long, city long, channel string")
    nodes = spark.createDataFrame([(1, 1, None, None, 5), (2, 1, 1, None, 6), (3, 1, None, "a", 7)], "node_id long, province long, city long, channel string, dealer_id long")
    got = {r.store_id: (r.node_id, r.cause) for r in ownership.rule_assign(stores, nodes, ownership.DIMS).collect()}
    assert got == {1: (3, "RULE"), 2: (None, "UNASSIGNED")}


def test_equality_index_and_rebalance(spark):
    assert sizing.eq_index(spark.createDataFrame([(1, 1), (2, 3)], "territory_id long, load long")).first().eq == 0.8
    accounts = spark.createDataFrame([(0, 1, 1, 4), (0, 2, 1, 3), (0, 3, 2, 1)], "scope long, account_id long, territory_id long, load long")
    moves = sizing.rebalance(accounts).orderBy("step").collect()
    assert all(a.eq < b.eq for a, b in zip(moves, moves[1:], strict=False))


def test_exclusive_conflicts_of_all_years(spark, tmp_path):
    data = [(1, 7, "1995-01-05"), (2, 7, "1995-01-20"), (3, 7, "1997-12-20"), (4, 7, "1998-01-10"), (5, 8, "1998-03-01"), (6, 8, "1998-03-30"), (7, 8, "1998-03-31"), (11, 8, "1996-03-01"), (16, 8, "1996-03-02")]
    spark.createDataFrame(data, "o_orderkey long, o_custkey long, d string").selectExpr("o_orderkey", "o_custkey", "CAST(d AS TIMESTAMP) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    day = {k: date.fromisoformat(d) for k, _, d in data}
    want = {(s, a % 5, b % 5) for a, s, _ in data for b, t, _ in data if s == t and a % 5 < b % 5 and abs((day[a] - day[b]).days) < 30}
    assert (7, 1, 2) in want
    assert rows(catalog.queries()["m10_exclusive_conflicts"](spark, str(tmp_path)).collect()) == rows(want)


def test_fence_queries_read_all_components(spark):
    q = {k: catalog.queries()[k](spark, SF).collect() for k in ("j13_fence_adjacency", "p11_haversine", "p23_clip_half_plane", "s5_wkt_fences", "s6_rep_fence_problems")}
    rings = {(r.dealer_id, r.comp): [(p.x, p.y) for p in r.ring] for r in bindings.fences(spark, SF).collect()}
    assert any(comp == 2 for _, comp in rings)
    box = {k: (min(x for x, _ in v), min(y for _, y in v), max(x for x, _ in v), max(y for _, y in v)) for k, v in rings.items()}
    meet = {(a, b) for (a, m), p in box.items() for (b, n), o in box.items() if a < b and p[0] <= o[2] and o[0] <= p[2] and p[1] <= o[3] and o[1] <= p[3]}
    assert rows(q["j13_fence_adjacency"]) == rows(meet)
    centre = {k: (sum(x for x, _ in v) / len(v), sum(y for _, y in v) / len(v)) for k, v in rings.items()}
    stores, seconds = {r.store_id: (r.x, r.y) for r in bindings.stores(spark, SF).collect()}, 0

    def arc(*at):
        x, y, mx, my = (math.radians(c / 1e6) for c in at)
        return 2 * 6371.0 * math.asin(math.sqrt(math.sin((my - y) / 2) ** 2 + math.cos(y) * math.cos(my) * math.sin((mx - x) / 2) ** 2))

    for r in q["p11_haversine"]:
        x, y = stores.pop(r.store_id)
        km, *near = min((arc(x, y, *c), *k) for k, c in centre.items())
        assert r.dealer_id == near[0] and r.km == pytest.approx(km, abs=2e-6)
        seconds += near[1] == 2
    assert not stores and seconds
    line = {r.dealer_id: r.cy - r.h // 2 for r in bindings.dealers(spark, SF).collect()}
    assert {(r.dealer_id, r.comp) for r in q["p23_clip_half_plane"]} == set(rings)
    for r in q["p23_clip_half_plane"]:
        low, high = box[r.dealer_id, r.comp][1::2]
        assert (r.low, r.high) == ((max(low, line[r.dealer_id]), high) if high >= line[r.dealer_id] else (None, None)) and (r.vertices > 0) == (r.low is not None)
    assert len(q["s5_wkt_fences"]) == sum(k % 10 != 0 for k, _ in rings)
    found = Counter(r.problem for r in q["s6_rep_fence_problems"])
    assert found["empty_geometry"] == sum(k % 10 == 0 for k, _ in rings) and found["area_off"] == sum(k % 4 == 0 and k % 10 != 0 for k, _ in rings)
    assert found["duplicate_code"] == sum(k % 7 == 0 and (k + 1, 1) in rings for k, comp in rings if comp == 1)
