"""Queries that write packs into the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.bindings import sql
from terrane.operators import scenarios as S
from terrane.operators import spatial
from terrane.plans import scenarios
from terrane.session import shared_dir
from terrane.sources import packs


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fences(spark, d):
    path = _folder(spark, "fences")
    packs.write_pack(B.fences(spark, d).select(F.concat_ws("-", "dealer_id", "comp").alias("area_id"), F.col("dealer_id").cast("string").alias("dealer"), F.lit(1.5).alias("area_km2"), packs.to_disk(F.col("ring")).alias("rings"), (F.col("dealer_id") % 3).cast("int").alias("region_id")), path)
    ring = packs.read_fences(spark, path).select("region_id", "area_id", "dealer", "area_km2", F.explode("ring").alias("p"))
    return ring.groupBy("region_id", "area_id", "dealer", "area_km2").agg(F.count("*").alias("points"), F.round(F.sum("p.lon"), 5).alias("lon"), F.round(F.sum("p.lat"), 5).alias("lat"))


def stores(spark, d):
    path = _folder(spark, "stores")
    packs.write_pack(B.stores(spark, d).selectExpr("CAST(store_id AS STRING) AS name", "channel AS category", "CAST(NULL AS STRING) AS upstream", "x / 1e6 AS lon", "y / 1e6 AS lat", "CASE WHEN direct THEN 'True' ELSE 'true' END AS direct", "district AS region_id"), path)
    return packs.read_stores(spark, path).select("region_id", "name", "category", "direct", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def rep_rows(spark, d):
    """Rep fences through CSV: every 10th without geometry, every 7th under its neighbour's code, stated areas of h * h. Later components have codes of their own."""
    path = _folder(spark, "reps")
    f = B.fences(spark, d)
    code = "CASE WHEN dealer_id % 7 = 0 THEN dealer_id + 1 ELSE dealer_id END"
    area = F.round(spatial.ring_area_km2(F.col("ring"), B.X0, B.Y0, 22.5) * F.when(F.col("dealer_id") % 4 == 0, 2.0).otherwise(1.1), 6)
    f.select(F.expr(f"concat({code}, CASE WHEN comp > 1 THEN concat('-', comp) ELSE '' END)").alias("code"), F.lit("x").alias("owner"), area.alias("area_km2"), F.when(F.col("dealer_id") % 10 != 0, packs.wkt(F.col("ring"))).otherwise("POLYGON EMPTY").alias("wkt")).write.option("header", True).csv(path)
    return packs.read_rep_fences(spark, path)


def boxes(spark, d):
    return packs.parse_wkt(rep_rows(spark, d))[0].select("code", F.size("ring").cast("int").alias("points"), "x0", "y0", "x1", "y1")


def problems(spark, d):
    good, bad = packs.parse_wkt(rep_rows(spark, d))
    rows = good.select("code", "area_km2", "ring").unionByName(bad.select("code", "area_km2", "ring"))
    whole = F.transform("ring", lambda p: F.struct(F.round(p["lon"] * 1e6).cast("long").alias("x"), F.round(p["lat"] * 1e6).cast("long").alias("y")))
    return packs.diagnose(rows, spatial.ring_area_km2(whole, B.X0, B.Y0, 22.5))


def set_sink(spark, d):
    """Unit sets before and, for the dealers that a move touches, after it; the latest of each."""
    path = _folder(spark, "sets")
    case = scenarios.Case(spark, d)
    before, chosen = case.sets, case.picked
    touched = chosen.select(F.explode(F.array("src", "dst")).alias("dealer_id")).distinct()
    packs.append_sets(before, before, path, 1)
    packs.append_sets(S.transfer_units(before, chosen), touched, path, 2)
    return packs.latest_sets(spark, path).groupBy("dealer_id", "set_version").agg(F.count("*").alias("units"))


QUERIES = {"s1_fence_pack": fences, "s2_store_pack": stores, "s5_wkt_fences": boxes, "s6_rep_fence_problems": problems, "s12_unit_set_sink": set_sink}
_CODE = "CASE WHEN dealer_id % 7 = 0 THEN dealer_id + 1 ELSE dealer_id END || CASE WHEN comp > 1 THEN '-' || comp ELSE '' END"
_REP = "SELECT DISTINCT dealer_id, comp FROM fence_vertex"
_TOUCH = "SELECT src AS dealer_id FROM picked UNION SELECT dst FROM picked"
SQL = {
    "s1_fence_pack": sql("SELECT CAST(dealer_id % 3 AS INTEGER) AS region_id, dealer_id || '-' || comp AS area_id, CAST(dealer_id AS VARCHAR) AS dealer, 1.5::DOUBLE AS area_km2, count(*) AS points, round(sum(x / 1e6), 5) AS lon, round(sum(y / 1e6), 5) AS lat FROM fence_vertex GROUP BY dealer_id, comp"),
    "s2_store_pack": sql("SELECT district AS region_id, CAST(store_id AS VARCHAR) AS name, channel AS category, direct, round(x / 1e6, 6) AS lon, round(y / 1e6, 6) AS lat FROM store"),
    "s5_wkt_fences": sql(f"SELECT {_CODE} AS code, CAST(count(*) AS INTEGER) AS points, round(min(x) / 1e6, 6) AS x0, round(min(y) / 1e6, 6) AS y0, round(max(x) / 1e6, 6) AS x1, round(max(y) / 1e6, 6) AS y1 FROM fence_vertex WHERE dealer_id % 10 <> 0 GROUP BY dealer_id, comp"),
    "s6_rep_fence_problems": sql(f"SELECT {_CODE} AS code, 'empty_geometry' AS problem FROM rep WHERE dealer_id % 10 = 0 UNION ALL SELECT {_CODE}, 'duplicate_code' FROM rep GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT {_CODE}, 'area_off' FROM rep WHERE dealer_id % 10 <> 0 AND dealer_id % 4 = 0", rep=_REP),
    "s12_unit_set_sink": sql(f"SELECT dealer_id, CAST(2 AS INTEGER) AS set_version, count(*) AS units FROM later WHERE dealer_id IN ({_TOUCH}) GROUP BY 1 UNION ALL SELECT dealer_id, 1, count(*) FROM sets WHERE dealer_id NOT IN ({_TOUCH}) GROUP BY 1", **scenarios._V),
}
