"""Views that give the star-schema tables coordinates and roles: stores, dealers, fences, upstream suppliers, gaps, units.

Coordinates are whole micro-degrees, money is whole cents, so both engines compute the same numbers. PRELUDE has the same
views as DuckDB common table expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.session import table

#: South-west corner of the one-degree window that holds all stores and fences.
X0, Y0, SIDE = 113_000_000, 22_500_000, 1_000_000


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(store_id, channel, district, direct, x, y)."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS store_id", "c_mktsegment AS channel", "c_nationkey AS district", "c_mktsegment = 'FURNITURE' AS direct",
        f"{X0} + (c_custkey * 7919 * 31) % {SIDE} AS x", f"{Y0} + (c_custkey * 104729 * 17) % {SIDE} AS y")


def dealers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dealer_id, cx, cy, cx2, cy2, h): two centres and a half-width that shrinks as dealers grow in number."""
    rows = table(spark, sf_dir, "supplier")
    n = rows.agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(n)).selectExpr(  # n is one row
        "s_suppkey AS dealer_id", f"{X0} + (s_suppkey * 15485863) % {SIDE} AS cx", f"{Y0} + (s_suppkey * 32452843) % {SIDE} AS cy",
        f"{X0} + (s_suppkey * 49979687 + 500000) % {SIDE} AS cx2", f"{Y0} + (s_suppkey * 67867967 + 250000) % {SIDE} AS cy2",
        "CAST(floor(600000 / sqrt(n) * (80 + 10 * (s_suppkey % 5)) / 100) AS BIGINT) AS h")


def fence_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dealer_id, comp, pos, x, y): an L-shape for each dealer, and a far square for every fifth."""
    corner = "named_struct('comp', {c}, 'pos', {p}, 'x', {x}, 'y', {y})"
    first = [corner.format(c=1, p=p, x=f"cx + ({dx}) * h", y=f"cy + ({dy}) * h") for p, (dx, dy) in enumerate([(-1, -1), (1, -1), (1, 0), (0, 0), (0, 1), (-1, 1)])]
    half = "(h div 2)"
    second = [corner.format(c=2, p=p, x=f"cx2 + ({dx}) * {half}", y=f"cy2 + ({dy}) * {half}") for p, (dx, dy) in enumerate([(-1, -1), (1, -1), (1, 1), (-1, 1)])]
    return dealers(spark, sf_dir).selectExpr("dealer_id", f"inline(CASE WHEN dealer_id % 5 = 0 THEN array({', '.join(first + second)}) ELSE array({', '.join(first)}) END)")


def fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dealer_id, comp, ring): one row per component, the ring as an array of (x, y)."""
    points = F.sort_array(F.collect_list(F.struct("pos", "x", "y")))  # a ring's own vertices
    return fence_vertices(spark, sf_dir).groupBy("dealer_id", "comp").agg(F.transform(points, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("ring"))


def main_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(store_id, supplier): the supplier of the largest value per customer, lowest id on a tie."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    sums = lines.join(orders, "l_orderkey").groupBy("o_custkey", "l_suppkey").agg(F.sum("cents").alias("cents"))
    return sums.groupBy(F.col("o_custkey").alias("store_id")).agg(F.max_by("l_suppkey", F.struct("cents", -F.col("l_suppkey"))).alias("supplier"))


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, period, observed, reference): errors per scope and day against the mean daily errors of all scopes."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("scope"), F.to_date("ts").alias("period"), (F.col("event_type") == "error").cast("long").alias("bad"))
    daily = e.groupBy("scope", "period").agg(F.sum("bad").alias("observed"))
    return daily.crossJoin(F.broadcast(daily.agg(F.avg("observed").alias("reference"))))  # one row


def workloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(account_id, territory_id, calls, minutes): calls are orders, minutes per call come from the quantity ordered."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_orderkey").alias("l_orderkey"))
    q = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"))
    per = o.join(q, "l_orderkey", "left").groupBy("account_id").agg(F.count_distinct("l_orderkey").alias("calls"), F.coalesce(F.sum("q"), F.lit(0)).alias("q"))
    where = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"), F.col("c_nationkey").alias("territory_id"))
    return per.join(where, "account_id").select("account_id", "territory_id", "calls", (F.lit(10) + F.expr("q div calls")).alias("minutes"))


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(territory_id, x_km, y_km, headroom)."""
    return dealers(spark, sf_dir).selectExpr("dealer_id AS territory_id", "cx / 9000 AS x_km", "cy / 9000 AS y_km", "(dealer_id * 7) % 9 - 2 AS headroom")


def grid(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """(cells along a side, width of a cell) of the unit grid, which grows finer with the number of stores."""
    n = 10 * max(1, math.ceil(math.sqrt(table(spark, sf_dir, "customer").count() / 600)))
    return n, SIDE // n


def cell(n: int, step: int, x: str = "x", y: str = "y") -> str:
    """SQL of the unit_id of a point."""
    return f"least(({x} - {X0}) div {step}, {n - 1}) * {n} + least(({y} - {Y0}) div {step}, {n - 1})"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit_id, i, j, x, y, street, district): the grid cells that hold a store, by their centres; streets are blocks of
    5 x 5 cells, districts of 10 x 10."""
    n, step = grid(spark, sf_dir)
    cells = stores(spark, sf_dir).selectExpr(f"{cell(n, step)} AS unit_id").distinct().selectExpr("unit_id", f"unit_id div {n} AS i", f"unit_id % {n} AS j")
    return cells.selectExpr(
        "unit_id", "i", "j", f"{X0} + i * {step} + {step // 2} AS x", f"{Y0} + j * {step} + {step // 2} AS y", f"(i div 5) * {n // 5} + j div 5 AS street", f"(i div 10) * {n // 10} + j div 10 AS district")


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, seg, pos, x, y): lines named by brand, one vertex per part, in order of part."""
    return table(spark, sf_dir, "part").selectExpr(
        "p_brand AS name", "p_partkey % 4 AS seg", "p_partkey AS pos", f"{X0} + (p_partkey * 611953) % {SIDE} AS x", f"{Y0} + (p_partkey * 746773) % {SIDE} AS y")


#: The same views for DuckDB, each by name with the views it needs before it.
VIEWS = {
    "store": f"SELECT c_custkey AS store_id, c_mktsegment AS channel, c_nationkey AS district, c_mktsegment = 'FURNITURE' AS direct, {X0} + (c_custkey * 7919 * 31) % {SIDE} AS x, {Y0} + (c_custkey * 104729 * 17) % {SIDE} AS y FROM customer",
    "dealer": f"SELECT s_suppkey AS dealer_id, {X0} + (s_suppkey * 15485863) % {SIDE} AS cx, {Y0} + (s_suppkey * 32452843) % {SIDE} AS cy, {X0} + (s_suppkey * 49979687 + 500000) % {SIDE} AS cx2, {Y0} + (s_suppkey * 67867967 + 250000) % {SIDE} AS cy2, CAST(floor(600000 / sqrt((SELECT count(*) FROM supplier)) * (80 + 10 * (s_suppkey % 5)) / 100) AS BIGINT) AS h FROM supplier",
    "fence_vertex": "SELECT dealer_id, 1 AS comp, pos, cx + dx * h AS x, cy + dy * h AS y FROM dealer, (VALUES (0,-1,-1),(1,1,-1),(2,1,0),(3,0,0),(4,0,1),(5,-1,1)) v(pos, dx, dy) UNION ALL SELECT dealer_id, 2, pos, cx2 + dx * (h // 2), cy2 + dy * (h // 2) FROM dealer, (VALUES (0,-1,-1),(1,1,-1),(2,1,1),(3,-1,1)) v(pos, dx, dy) WHERE dealer_id % 5 = 0",
    "fence_edge": "SELECT dealer_id, comp, pos, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM fence_vertex WINDOW w AS (PARTITION BY dealer_id, comp ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "held": "SELECT store_id, dealer_id, comp FROM (SELECT store_id, dealer_id, comp, count(*) AS n FROM store s JOIN fence_edge e ON (e.y1 > s.y) <> (e.y2 > s.y) AND CASE WHEN e.y2 > e.y1 THEN (s.x - e.x1) * (e.y2 - e.y1) < (s.y - e.y1) * (e.x2 - e.x1) ELSE (s.x - e.x1) * (e.y2 - e.y1) > (s.y - e.y1) * (e.x2 - e.x1) END GROUP BY ALL) WHERE n % 2 = 1",
    "main_supplier": "SELECT o_custkey AS store_id, arg_max(l_suppkey, (cents, -l_suppkey)) AS supplier FROM (SELECT o_custkey, l_suppkey, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL) GROUP BY 1",
    "kinded": "SELECT s.*, d.dealers, d.n_dealers, u.upstream, CASE WHEN d.n_dealers > 1 THEN 'MULTI' WHEN coalesce(d.n_dealers, 0) = 0 THEN CASE WHEN direct THEN 'DIRECT' ELSE 'GAP' END WHEN direct THEN 'DIRECT_IN' WHEN u.upstream = d.first_dealer THEN 'OK' ELSE 'OOF' END AS kind, d.first_dealer FROM store s LEFT JOIN (SELECT store_id, string_agg(dealer_id, ',' ORDER BY dealer_id) AS dealers, count(*) AS n_dealers, min(dealer_id) AS first_dealer FROM (SELECT DISTINCT store_id, dealer_id FROM held) GROUP BY 1) d USING (store_id) LEFT JOIN (SELECT s.store_id, CASE WHEN s.store_id % 11 = 0 THEN NULL WHEN s.store_id % 3 <> 0 AND h.d IS NOT NULL THEN h.d ELSE m.supplier END AS upstream FROM store s LEFT JOIN main_supplier m USING (store_id) LEFT JOIN (SELECT store_id, min(dealer_id) AS d FROM held GROUP BY 1) h USING (store_id)) u USING (store_id)",
    "centroid": "SELECT dealer_id, comp, avg(x) AS mx, avg(y) AS my FROM fence_vertex GROUP BY 1, 2",
    "area": "SELECT dealer_id, comp, abs(sum(x1 * y2 - x2 * y1)) / 2.0 / 1e12 * 111.32 * 111.32 * cos(radians(22.5)) AS area_km2 FROM (SELECT dealer_id, comp, x1 - 113000000 AS x1, y1 - 22500000 AS y1, x2 - 113000000 AS x2, y2 - 22500000 AS y2 FROM fence_edge) GROUP BY 1, 2",
    "daily": "SELECT user_id % 8 AS scope, CAST(ts AS DATE) AS period, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS observed FROM events GROUP BY 1, 2",
    "gap": "SELECT scope, period, observed, (SELECT avg(observed) FROM daily) AS reference FROM daily",
    "workload": "SELECT account_id, c_nationkey AS territory_id, calls, 10 + q // calls AS minutes FROM (SELECT o_custkey AS account_id, count(DISTINCT o_orderkey) AS calls, coalesce(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT), 0) AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) JOIN customer ON c_custkey = account_id",
    "container": "SELECT dealer_id AS territory_id, cx / 9000 AS x_km, cy / 9000 AS y_km, (dealer_id * 7) % 9 - 2 AS headroom FROM dealer",
    "grid": "SELECT n, 1000000 // n AS step FROM (SELECT 10 * greatest(1, CAST(ceil(sqrt(count(*) / 600.0)) AS BIGINT)) AS n FROM customer)",
    "unit": f"SELECT i * n + j AS unit_id, i, j, {X0} + i * step + step // 2 AS x, {Y0} + j * step + step // 2 AS y, (i // 5) * (n // 5) + j // 5 AS street, (i // 10) * (n // 10) + j // 10 AS district FROM (SELECT DISTINCT least((x - {X0}) // step, n - 1) AS i, least((y - {Y0}) // step, n - 1) AS j, n, step FROM store, grid)",
    "landmark": f"SELECT p_brand AS name, p_partkey % 4 AS seg, p_partkey AS pos, {X0} + (p_partkey * 611953) % {SIDE} AS x, {Y0} + (p_partkey * 746773) % {SIDE} AS y FROM part",
    "unit_in": "SELECT unit_id, dealer_id, comp FROM (SELECT unit_id, dealer_id, comp, count(*) AS n FROM unit s JOIN fence_edge e ON (e.y1 > s.y) <> (e.y2 > s.y) AND CASE WHEN e.y2 > e.y1 THEN (s.x - e.x1) * (e.y2 - e.y1) < (s.y - e.y1) * (e.x2 - e.x1) ELSE (s.x - e.x1) * (e.y2 - e.y1) > (s.y - e.y1) * (e.x2 - e.x1) END GROUP BY ALL) WHERE n % 2 = 1",
}


def sql(body: str, **more: str) -> str:
    """``body`` after the views; ``more`` views come last."""
    return "WITH " + ",\n".join(f"{name} AS ({text})" for name, text in (VIEWS | more).items()) + "\n" + body
