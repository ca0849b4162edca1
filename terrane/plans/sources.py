"""Queries on packs, knowledge, map extracts, coordinate systems and pack rules. Files are written from the tables first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.bindings import sql
from terrane.plans import containment as P
from terrane.session import shared_dir, table
from terrane.sources import packs


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def pack(spark, d):
    """Rows of each part of a pack by region, after a round trip through files."""
    path = _folder(spark, "pack")
    region = lambda c: (F.col(c) % 3).cast("int").alias("region_id")
    write = lambda df, part: df.write.partitionBy("region_id").json(f"{path}/{part}")
    write(B.fences(spark, d).select(F.concat_ws("-", "dealer_id", "comp").alias("area_id"), F.col("dealer_id").cast("string").alias("dealer"), F.lit(1.0).alias("area_km2"), packs.to_disk(F.col("ring")).alias("rings"), region("dealer_id")), "fences")
    write(B.stores(spark, d).select(F.col("store_id").cast("string").alias("name"), F.col("channel").alias("category"), (F.col("x") / 1e6).alias("lon"), (F.col("y") / 1e6).alias("lat"), F.lit("True").alias("direct"), region("store_id")), "stores")
    write(B.dealers(spark, d).select(F.col("dealer_id").cast("string").alias("dealer_id"), F.create_map(F.lit("西"), F.lit("x")).alias("four_bounds"), F.lit(5).alias("store_count"), region("dealer_id")), "contracts")
    parts = packs.read_pack(spark, path)
    counts = [df.groupBy("region_id").agg(F.count("*").alias("n")).withColumn("part", F.lit(name)) for name, df in parts.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def knowledge(spark, d):
    """Items and open gaps, from a knowledge file for each region of the world."""
    n = table(spark, d, "nation")
    item = F.struct(F.concat(F.lit("K-"), F.col("n_nationkey")).alias("id"), F.lit("RULE").alias("type"), F.col("n_name").alias("statement"), F.lit("").alias("conditions"), F.lit("table").alias("source"), (F.col("n_nationkey") / 25).alias("confidence"), F.lit("").alias("maps_to"))
    path = _folder(spark, "knowledge")
    files = n.groupBy("n_regionkey").agg(F.struct(F.concat(F.lit("v"), F.first("n_regionkey").cast("string")).alias("version")).alias("_meta"), F.collect_list(item).alias("items"), F.array(F.concat(F.lit("open "), F.first("n_regionkey").cast("string"))).alias("knowledge_gaps_needing_business_input"))
    files.write.partitionBy("n_regionkey").json(path)
    return packs.read_knowledge(spark, path)


def items(spark, d):
    found, gaps = knowledge(spark, d)
    return found.groupBy("version").agg(F.count("*").alias("items"), F.round(F.avg("confidence"), 9).alias("confidence")).join(gaps, "version")


def chains(spark, d):
    """(chain_id, pos, kb_id, data_ref, spec_ref): evidence of each supplier's advice; some without source, with an unknown item, or none."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("chain_id"))
    some = s.where("chain_id % 7 <> 0").withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr("chain_id", "pos", "CASE WHEN (chain_id + pos) % 4 <> 0 THEN concat('K-', (chain_id + pos) % 30) END AS kb_id", "CASE WHEN chain_id % 5 = 1 THEN 'rows' END AS data_ref", "CAST(NULL AS STRING) AS spec_ref")
    return some.unionByName(s.where("chain_id % 7 = 0").selectExpr("chain_id", "CAST(NULL AS INT) AS pos", "CAST(NULL AS STRING) AS kb_id", "CAST(NULL AS STRING) AS data_ref", "CAST(NULL AS STRING) AS spec_ref"))


def citations(spark, d):
    return packs.cited(chains(spark, d), knowledge(spark, d)[0])


# Tags by number of the line, as both engines read them.
_TAGS = {"name": "CASE WHEN k % 9 <> 0 THEN concat('W', k % 9) ELSE '' END", "waterway": "CASE k % 4 WHEN 0 THEN 'river' WHEN 1 THEN 'drain' ELSE '' END", "highway": "CASE k % 5 WHEN 0 THEN 'primary' WHEN 1 THEN 'service' WHEN 2 THEN 'trunk' ELSE '' END", "ref": "CASE WHEN k % 3 = 0 THEN concat('G', k % 6) ELSE 'S1' END", "boundary": "CASE WHEN k % 6 = 1 THEN 'administrative' ELSE '' END", "admin_level": "CASE WHEN k % 2 = 1 THEN '8' ELSE '6' END"}


def extract(spark, d):
    """A map extract with one way for each line of parts, and one relation for each fence, its ring as three ways that meet."""
    lines = table(spark, d, "part").selectExpr("p_partkey div 4 AS k", "p_partkey AS pos", "CAST(p_partkey AS DOUBLE) AS lon", "CAST(p_size AS DOUBLE) AS lat").where("k % 11 <> 0 OR pos % 4 = 0")
    point = F.sort_array(F.collect_list(F.struct("pos", "lon", "lat")))  # a line's own vertices
    geometry = lambda c: F.transform(c, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    tags = F.expr("map_filter(map(" + ", ".join(f"'{t}', {e}" for t, e in _TAGS.items()) + "), (k, v) -> v <> '')")
    ways = lines.groupBy("k").agg(point.alias("p")).select(F.lit("way").alias("type"), F.col("k").alias("id"), tags.alias("tags"), geometry("p").alias("geometry"), F.lit(None).cast("array<struct<type:string,role:string,geometry:array<struct<lon:double,lat:double>>>>").alias("members"))
    ring = F.transform("ring", lambda p: F.struct((p["x"] / 1e6).alias("lon"), (p["y"] / 1e6).alias("lat")))
    f = B.fences(spark, d).select("dealer_id", "comp", ring.alias("r"), F.size("ring").alias("n"))
    member = lambda role, g: F.struct(F.lit("way").alias("type"), F.lit(role).alias("role"), g.alias("geometry"))
    cut = [member("outer", F.slice("r", 1, 3)), member("inner", F.slice("r", 1, 2)), member("", F.expr("slice(r, 3, n - 2)")), member("outer", F.concat(F.slice("r", -1, 1), F.slice("r", 1, 1)))]
    tags = F.create_map(F.lit("name"), F.concat_ws("-", F.lit("F"), "dealer_id", "comp"), F.lit("boundary"), F.lit("administrative"), F.lit("admin_level"), F.when(F.col("dealer_id") % 2 == 0, "8").otherwise("4"))
    relations = f.select(F.lit("relation").alias("type"), (F.col("dealer_id") * 10 + F.col("comp")).alias("id"), tags.alias("tags"), F.lit(None).cast("array<struct<lon:double,lat:double>>").alias("geometry"), F.array(*cut).alias("members"))
    path = _folder(spark, "extract")
    every = ways.unionByName(relations)
    every.groupBy(F.pmod("id", F.lit(64)).alias("file")).agg(F.collect_list(F.struct("type", "id", "tags", "geometry", "members")).alias("elements")).write.partitionBy("file").json(path)
    return path


def extract_lines(spark, d):
    return packs.landmark_lines(spark, extract(spark, d)).groupBy("class", "name").agg(F.count("*").alias("segments"), F.sum(F.size("points")).alias("points"))


def extract_rings(spark, d):
    return packs.stitched(spark, extract(spark, d)).select("name", "ring", F.size("points").alias("points"), (F.element_at("points", -1) == F.get("points", F.lit(0))).alias("closed"))


def moved_systems(spark, d):
    """Stores of packs in a shifted system, and of every third in WGS-84, in WGS-84: where they go, and how far off the way back is."""
    s = B.stores(spark, d).select("store_id", (F.col("x") / 1e6).alias("lon"), (F.col("y") / 1e6).alias("lat"), packs.is_shifted(F.when(F.col("store_id") % 3 == 0, "wgs84").when(F.col("store_id") % 3 == 1, "gcj_02")).alias("shifted"))
    lon, lat = packs.to_wgs(F.col("lon"), F.col("lat"), F.col("shifted"))
    s = s.withColumns({"wlon": lon, "wlat": lat})
    blon, blat = packs.from_wgs(F.col("wlon"), F.col("wlat"), F.col("shifted"))
    off = F.greatest(F.abs(blon - F.col("lon")), F.abs(blat - F.col("lat")))
    return s.select("store_id", F.round("wlon", 6).alias("lon"), F.round("wlat", 6).alias("lat"), (off < 2e-5).alias("back"))


def written(spark, d):
    """Stores as packs write them: every other region in the shifted system, the others as they are, 6 digits; read again as text."""
    path = _folder(spark, "written")
    s = B.stores(spark, d).select("store_id", (F.col("x") / 1e6).alias("lon"), (F.col("y") / 1e6).alias("lat"), (F.col("district") % 4).alias("region_id"))
    lon, lat = packs.from_wgs(F.col("lon"), F.col("lat"), F.col("region_id") % 2 == 1)
    packs.write_pack(s.select(F.col("store_id").cast("string").alias("name"), lon.alias("lon"), lat.alias("lat"), "region_id"), path)
    return packs.read_stores(spark, path).select(F.col("name").cast("long").alias("store_id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.col("region_id").cast("int").alias("region_id"))


def rings(spark, d):
    """Rings in hundredths of a degree, rounded to whole ones, closed and without repeats."""
    r = F.transform("ring", lambda p: F.struct((p["x"] / 1e4).alias("x"), (p["y"] / 1e4).alias("y")))
    n = B.fences(spark, d).select("dealer_id", "comp", packs.normalised_ring(r, 0).alias("r"))
    return n.select("dealer_id", "comp", F.size("r").alias("points"), (F.element_at("r", -1) == F.get("r", F.lit(0))).alias("closed"))


def area_ids(spark, d):
    return B.fences(spark, d).select("dealer_id", "comp", packs.generated_area_id(F.col("dealer_id"), F.col("comp")).alias("area_id"))


def broken(spark, d):
    """Pack rules on packs with planted faults: counts by rule and region."""
    region = lambda c: (F.col(c) % 3).cast("int").alias("region_id")
    fences = B.fences(spark, d).select(F.when(F.col("dealer_id") % 9 != 4, F.concat_ws("-", "dealer_id", "comp")).alias("area_id"), F.col("dealer_id").cast("string").alias("dealer"), F.when(F.col("dealer_id") % 8 != 2, 1.0).alias("area_km2"), F.lit("[]").alias("rings"), region("dealer_id"))
    stores = P.kinded(spark, d).select(F.col("store_id").cast("string").alias("name"), F.col("channel").alias("category"), F.when(F.col("store_id") % 17 != 5, F.col("district")).alias("district"), F.when(F.col("store_id") % 19 == 3, 400.0).otherwise(F.col("x") / 1e6).alias("lon"), F.when(F.col("store_id") % 23 != 7, F.col("y") / 1e6).alias("lat"), F.lit("True").alias("direct"), F.when(F.col("store_id") % 29 == 11, "ODD").otherwise(F.col("kind")).alias("kind"), region("store_id"))
    contracts = B.dealers(spark, d).select((F.col("dealer_id") * 2).cast("string").alias("dealer_id"), F.lit("x").alias("district"), (F.col("dealer_id") * 2 % 3).cast("int").alias("region_id"))
    kinds = stores.where("kind <> 'MULTI'").groupBy("region_id", "kind").agg(F.count("*").alias("n"))
    return packs.violations(fences, stores, contracts, kinds).groupBy("rule", "region_id").agg(F.count("*").alias("n"))


QUERIES = {
    "s3_pack_parts": pack,
    "s4_knowledge": items,
    "j16_citations": lambda s, d: citations(s, d)[0].select("chain_id", "pos", "kb_id", "type", F.round("confidence", 9).alias("confidence"), "statement"),
    "j16_chain_problems": lambda s, d: citations(s, d)[1],
    "s7_landmark_lines": extract_lines,
    "s8_stitched_rings": extract_rings,
    "s9_written_pack": written,
    "p12_coordinate_systems": moved_systems,
    "p18_normalised_rings": rings,
    "p25_area_ids": area_ids,
    "s10_pack_rules": broken,
}
_CHAIN = "SELECT s_suppkey AS chain_id, CAST(pos AS INTEGER) AS pos, CASE WHEN (s_suppkey + pos) % 4 <> 0 THEN 'K-' || ((s_suppkey + pos) % 30) END AS kb_id, CASE WHEN s_suppkey % 5 = 1 THEN 'rows' END AS data_ref FROM supplier, range(2) r(pos) WHERE s_suppkey % 7 <> 0"
_TAGGED = "SELECT k, n, " + ", ".join(f"{e} AS {t}" for t, e in _TAGS.items()) + " FROM (SELECT p_partkey // 4 AS k, count(*) AS n FROM part WHERE (p_partkey // 4) % 11 <> 0 OR p_partkey % 4 = 0 GROUP BY 1) WHERE n >= 2"
_X, _Y = "(lon - 105.0::DOUBLE)", "(lat - 35.0::DOUBLE)"
_PI = "3.14159265358979324::DOUBLE"
_SHORT = f"(20 * sin({_X} * 6 * {_PI}) + 20 * sin({_X} * 2 * {_PI})) * 2 / 3"
_DLAT = f"(-100 + 2 * {_X} + 3 * {_Y} + 0.2::DOUBLE * {_Y} * {_Y} + 0.1::DOUBLE * {_X} * {_Y} + 0.2::DOUBLE * sqrt(abs({_X})) + {_SHORT} + (20 * sin({_Y} * {_PI}) + 40 * sin({_Y} / 3 * {_PI})) * 2 / 3 + (160 * sin({_Y} / 12 * {_PI}) + 320 * sin({_Y} * {_PI} / 30)) * 2 / 3)"
_DLON = f"(300 + {_X} + 2 * {_Y} + 0.1::DOUBLE * {_X} * {_X} + 0.1::DOUBLE * {_X} * {_Y} + 0.1::DOUBLE * sqrt(abs({_X})) + {_SHORT} + (20 * sin({_X} * {_PI}) + 40 * sin({_X} / 3 * {_PI})) * 2 / 3 + (150 * sin({_X} / 12 * {_PI}) + 300 * sin({_X} / 30 * {_PI})) * 2 / 3)"
_MAGIC = "(1 - 0.00669342162296594323::DOUBLE * pow(sin(radians(lat)), 2))"
_FAULTS = "SELECT store_id, store_id % 3 AS region_id, CASE WHEN store_id % 29 = 11 THEN 'ODD' ELSE kind END AS kind FROM kinded"
SQL = {
    "s3_pack_parts": sql("SELECT CAST(dealer_id % 3 AS INTEGER) AS region_id, count(*) AS n, 'fences' AS part FROM (SELECT DISTINCT dealer_id, comp FROM fence_vertex) GROUP BY 1 UNION ALL SELECT CAST(store_id % 3 AS INTEGER), count(*), 'stores' FROM store GROUP BY 1 UNION ALL SELECT CAST(dealer_id % 3 AS INTEGER), count(*), 'contracts' FROM dealer GROUP BY 1"),
    "s4_knowledge": "SELECT 'v' || n_regionkey AS version, count(*) AS items, round(avg(n_nationkey / 25), 9) AS confidence, 'open ' || n_regionkey AS gap FROM nation GROUP BY n_regionkey",
    "j16_citations": f"WITH c AS ({_CHAIN}) SELECT chain_id, pos, kb_id, 'RULE' AS type, round(n_nationkey / 25, 9) AS confidence, n_name AS statement FROM c JOIN nation ON kb_id = 'K-' || n_nationkey",
    "j16_chain_problems": f"WITH c AS ({_CHAIN}) SELECT chain_id, pos, 'unknown_item' AS problem FROM c WHERE kb_id IS NOT NULL AND kb_id NOT IN (SELECT 'K-' || n_nationkey FROM nation) UNION ALL SELECT chain_id, pos, 'no_source' FROM c WHERE kb_id IS NULL AND data_ref IS NULL UNION ALL SELECT s_suppkey, NULL, 'empty_chain' FROM supplier WHERE s_suppkey % 7 = 0",
    "s7_landmark_lines": sql("SELECT class, name, CAST(count(*) AS BIGINT) AS segments, CAST(sum(n) AS BIGINT) AS points FROM (SELECT 'river' AS class, name, n FROM tagged WHERE waterway = 'river' AND name <> '' UNION ALL SELECT 'road', name, n FROM tagged WHERE highway IN ('primary', 'trunk') AND name <> '' UNION ALL SELECT 'ref', ref, n FROM tagged WHERE highway IN ('primary', 'trunk') AND starts_with(ref, 'G') UNION ALL SELECT 'district', name, n FROM tagged WHERE boundary = 'administrative' AND admin_level = '8' AND name <> '' UNION ALL SELECT 'district', 'F-' || dealer_id || '-' || comp, m FROM (SELECT dealer_id, comp, count(*) AS v FROM fence_vertex WHERE dealer_id % 2 = 0 GROUP BY 1, 2), LATERAL (VALUES (3), (2), (v - 2), (2)) t(m)) GROUP BY 1, 2", tagged=_TAGGED),
    "s8_stitched_rings": sql("SELECT 'F-' || dealer_id || '-' || comp AS name, CAST(0 AS INTEGER) AS ring, CAST(count(*) + 1 AS INTEGER) AS points, true AS closed FROM fence_vertex GROUP BY dealer_id, comp"),
    "p12_coordinate_systems": sql(f"SELECT store_id, round(CASE WHEN store_id % 3 = 0 THEN lon ELSE lon - {_DLON} * 180 / (6378245.0 / sqrt({_MAGIC}) * cos(radians(lat)) * {_PI}) END, 6) AS lon, round(CASE WHEN store_id % 3 = 0 THEN lat ELSE lat - {_DLAT} * 180 / (6378245.0 * (1 - 0.00669342162296594323::DOUBLE) / ({_MAGIC} * sqrt({_MAGIC})) * {_PI}) END, 6) AS lat, true AS back FROM (SELECT store_id, x / 1e6 AS lon, y / 1e6 AS lat FROM store)"),
    "s9_written_pack": sql(f"SELECT store_id, round(CASE WHEN region_id % 2 = 0 THEN lon ELSE lon + {_DLON} * 180 / (6378245.0 / sqrt({_MAGIC}) * cos(radians(lat)) * {_PI}) END, 6) AS lon, round(CASE WHEN region_id % 2 = 0 THEN lat ELSE lat + {_DLAT} * 180 / (6378245.0 * (1 - 0.00669342162296594323::DOUBLE) / ({_MAGIC} * sqrt({_MAGIC})) * {_PI}) END, 6) AS lat, region_id FROM (SELECT store_id, x / 1e6 AS lon, y / 1e6 AS lat, CAST(district % 4 AS INTEGER) AS region_id FROM store)"),
    "p18_normalised_rings": sql("SELECT dealer_id, comp, CAST(count(*) FILTER (WHERE pos = 0 OR x <> px OR y <> py) + CAST(arg_max(x, pos) <> arg_min(x, pos) OR arg_max(y, pos) <> arg_min(y, pos) AS INTEGER) AS INTEGER) AS points, true AS closed FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM (SELECT dealer_id, comp, pos, round_even(x / 1e4, 0) AS x, round_even(y / 1e4, 0) AS y FROM fence_vertex) WINDOW w AS (PARTITION BY dealer_id, comp ORDER BY pos)) GROUP BY 1, 2"),
    "p25_area_ids": sql("SELECT DISTINCT dealer_id, comp, 'A' || upper(substr(md5(CAST(dealer_id AS VARCHAR)), 1, 8)) || CASE WHEN comp > 1 THEN '-' || comp ELSE '' END AS area_id FROM fence_vertex"),
    "s10_pack_rules": sql("SELECT rule, CAST(r AS INTEGER) AS region_id, count(*) AS n FROM (SELECT 'fence.area_id' AS rule, dealer_id % 3 AS r FROM f WHERE dealer_id % 9 = 4 UNION ALL SELECT 'fence.area_km2', dealer_id % 3 FROM f WHERE dealer_id % 8 = 2 UNION ALL SELECT 'store.district', store_id % 3 FROM store WHERE store_id % 17 = 5 UNION ALL SELECT 'store.lat', store_id % 3 FROM store WHERE store_id % 23 = 7 UNION ALL SELECT 'coordinates', store_id % 3 FROM store WHERE store_id % 19 = 3 UNION ALL SELECT 'illegal_kind', store_id % 3 FROM store WHERE store_id % 29 = 11 UNION ALL SELECT 'kind_total', region_id FROM fault GROUP BY region_id HAVING count(*) FILTER (WHERE kind = 'MULTI') > 0 UNION ALL SELECT 'orphan_contract', dealer_id * 2 % 3 FROM dealer d WHERE dealer_id * 2 NOT IN (SELECT dealer_id FROM dealer)) GROUP BY 1, 2", f="SELECT DISTINCT dealer_id, comp FROM fence_vertex", fault=_FAULTS),
}
