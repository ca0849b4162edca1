"""Region packs as files: fences and stores as JSON lines partitioned by region, fences as CSV with WKT, versioned unit sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RINGS = "array<array<array<double>>>"
FENCE = "area_id string, dealer string, area_km2 double, rings string, region_id int"
STORE = "name string, category string, upstream string, lon double, lat double, direct string, region_id int"
REP = "code string, owner string, area_km2 double, wkt string"
PLACES = 6
#: Share by which a stated area may differ from the ring's.
AREA_TOLERANCE = 0.30


def write_pack(rows: DataFrame, path: str) -> None:
    """One folder per region, coordinates as they are written by ``to_disk``."""
    rows.write.partitionBy("region_id").mode("overwrite").json(path)


def to_disk(ring: Column) -> Column:
    """A ring of (x, y) in micro-degrees as JSON text of degrees, in a list of one."""
    return F.to_json(F.array(F.transform(ring, lambda p: F.array(F.round(p["x"] / 1e6, PLACES), F.round(p["y"] / 1e6, PLACES)))))


def read_fences(spark: SparkSession, path: str) -> DataFrame:
    """(region_id, area_id, dealer, area_km2, ring): the outer ring, as an array of (lon, lat). Rows whose rings can't be read
    have a null ring."""
    raw = spark.read.schema(FENCE).json(path)
    outer = F.get(F.from_json("rings", RINGS), F.lit(0))
    return raw.select("region_id", "area_id", "dealer", "area_km2", F.transform(outer, lambda p: F.struct(F.get(p, F.lit(0)).alias("lon"), F.get(p, F.lit(1)).alias("lat"))).alias("ring"))


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    """Typed stores; ``direct`` is true only for the text "True"."""
    return spark.read.schema(STORE).json(path).withColumn("direct", F.coalesce(F.col("direct") == "True", F.lit(False)))


def wkt(ring: Column) -> Column:
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(ring, lambda p: F.concat_ws(" ", (p["x"] / 1e6).cast("decimal(12,6)").cast("string"), (p["y"] / 1e6).cast("decimal(12,6)").cast("string"))), ", "), F.lit("))"))


def parse_wkt(rows: DataFrame, text: str = "wkt") -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows with ring and box (x0, y0, x1, y1) from all number pairs of ``text``; those with under three go to bad."""
    pair = r"(-?\d+(?:\.\d+)?)\s+(-?\d+(?:\.\d+)?)"
    t = F.coalesce(F.col(text), F.lit(""))
    number = lambda g: F.transform(F.regexp_extract_all(t, F.lit(pair), F.lit(g)), lambda v: v.cast("double"))
    out = rows.withColumn("ring", F.arrays_zip(number(1).alias("lon"), number(2).alias("lat")))
    box = {"x0": F.array_min("ring.lon"), "y0": F.array_min("ring.lat"), "x1": F.array_max("ring.lon"), "y1": F.array_max("ring.lat")}
    return out.where(F.size("ring") >= 3).withColumns(box), out.where(F.size("ring") < 3)


def read_rep_fences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REP).option("header", True).csv(path)


def diagnose(rows: DataFrame, ring_area: Column) -> DataFrame:
    """(code, problem) of rep fences (code, area_km2, ring): empty_geometry, duplicate_code, area_off; a row each."""
    empty = rows.where(F.size("ring") < 3).select("code", F.lit("empty_geometry").alias("problem"))
    twice = rows.groupBy("code").agg(F.count("*").alias("n")).where("n > 1").select("code", F.lit("duplicate_code").alias("problem"))
    off = rows.where((F.size("ring") >= 3) & (F.abs(F.col("area_km2") - ring_area) > AREA_TOLERANCE * ring_area)).select("code", F.lit("area_off").alias("problem"))
    return empty.unionByName(twice).unionByName(off)


def append_sets(sets: DataFrame, dealers: DataFrame, path: str, version: int) -> None:
    """Adds the unit sets (dealer_id, unit_id) of ``dealers`` as a version of their own; a dealer left without units gets one row
    with a null unit. Earlier versions stay as backup, a rerun replaces its own."""
    dealers.select("dealer_id").distinct().join(sets, "dealer_id", "left").select("dealer_id", "unit_id").write.mode("overwrite").parquet(f"{path}/set_version={version}")


def latest_sets(spark: SparkSession, path: str) -> DataFrame:
    """(dealer_id, unit_id, set_version): each dealer's units in the latest version that has the dealer."""
    every = spark.read.schema("dealer_id long, unit_id long, set_version int").parquet(path)
    last = every.groupBy("dealer_id").agg(F.max("set_version").alias("set_version"))
    return every.join(last, ["dealer_id", "set_version"]).where("unit_id IS NOT NULL")


#: Parts of a region pack, a folder for each, and the columns that are read from them.
CONTRACT = "dealer_id string, district string, four_bounds map<string,string>, center array<double>, reserved_channels array<string>, store_count long, region_id int"
META = "region_name string, center array<double>, zoom int, crs string, region_id int"
KNOWLEDGE = "_meta struct<version:string>, items array<struct<id:string,type:string,statement:string,conditions:string,source:string,confidence:double,maps_to:string>>, knowledge_gaps_needing_business_input array<string>"
OSM = "elements array<struct<type:string,id:long,tags:map<string,string>,geometry:array<struct<lon:double,lat:double>>,members:array<struct<type:string,role:string,geometry:array<struct<lon:double,lat:double>>>>>>"
# Coordinate systems that are moved to WGS-84 on reading, and the constants of the public offset formula.
SHIFTED = ["GCJ02", "BD09LL"]
AXIS, ECCENTRICITY = 6378245.0, 0.00669342162296594323
# Tags that make a way a river or a main road, and the level of districts.
WATER, MAIN_ROADS, DISTRICT_LEVEL = ["river", "canal", "stream"], ["motorway", "trunk", "primary", "secondary"], "8"
# The kinds that a store may have.
KINDS = ["OK", "OOF", "DIRECT_IN", "DIRECT", "GAP", "MULTI"]


def read_pack(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The parts of all region packs below ``path``, by name: fences, stores, contracts and meta. A part that no pack has is an
    empty table."""
    out = {}
    for part, schema in {"fences": FENCE, "stores": STORE, "contracts": CONTRACT, "meta": META}.items():
        files = spark.read.schema(schema).option("ignoreMissingFiles", True).option("pathGlobFilter", "*.json").option("basePath", path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}")
        there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        out[part] = files.json(f"{path}/{part}") if there else spark.createDataFrame([], schema)
    return out


def read_knowledge(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items, open gaps) of knowledge files: (version, id, type, statement, source, confidence) and (version, gap)."""
    raw = spark.read.schema(KNOWLEDGE).option("multiLine", True).json(path)
    items = raw.select(F.col("_meta.version").alias("version"), F.explode("items").alias("i")).select("version", "i.id", "i.type", "i.statement", "i.source", "i.confidence")
    return items, raw.select(F.col("_meta.version").alias("version"), F.explode("knowledge_gaps_needing_business_input").alias("gap"))


def cited(evidence: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citations, problems) of ``evidence`` (chain_id, pos, kb_id, data_ref, spec_ref); a chain without evidence is a row of nulls.

    Citations carry type, confidence, statement and source of the item. Problems: empty_chain, no_source (none of the three references) and
    unknown_item.
    """
    found = evidence.where("kb_id IS NOT NULL").join(items.select(F.col("id").alias("kb_id"), "type", "confidence", "statement", "source"), "kb_id", "left")
    unknown = found.where("type IS NULL").select("chain_id", "pos", F.lit("unknown_item").alias("problem"))
    bare = evidence.where("pos IS NOT NULL AND kb_id IS NULL AND data_ref IS NULL AND spec_ref IS NULL").select("chain_id", "pos", F.lit("no_source").alias("problem"))
    empty = evidence.groupBy("chain_id").agg(F.count("pos").alias("n")).where("n = 0").select("chain_id", F.lit(None).cast("int").alias("pos"), F.lit("empty_chain").alias("problem"))
    return found.where("type IS NOT NULL").select("chain_id", "pos", "kb_id", "type", "confidence", "statement", "source"), unknown.unionByName(bare).unionByName(empty)


def landmark_lines(spark: SparkSession, path: str) -> DataFrame:
    """(class, name, element, seg, points) of map extracts: rivers, main roads, numbered roads (ref) and districts by their tags.
    A way may be of several classes; ways of fewer than two points and elements without a name (a number, for ref) are none."""
    e = spark.read.schema(OSM).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*")
    tag = lambda k: F.coalesce(F.element_at("tags", F.lit(k)), F.lit(""))
    named, main = tag("name") != "", tag("highway").isin(MAIN_ROADS)
    district = (tag("boundary") == "administrative") & (tag("admin_level") == DISTRICT_LEVEL) & named
    classes = [("river", tag("waterway").isin(WATER) & named, tag("name")), ("road", main & named, tag("name")), ("ref", main & tag("ref").startswith("G"), tag("ref")), ("district", district, tag("name"))]
    kinds = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(c).alias("class"), name.alias("name"))) for c, test, name in classes)))
    ways = e.where("type = 'way' AND size(geometry) >= 2").select(F.explode(kinds).alias("c"), F.col("id").alias("element"), F.lit(0).alias("seg"), F.col("geometry").alias("points"))
    parts = e.where((F.col("type") == "relation") & district).select(F.struct(F.lit("district").alias("class"), tag("name").alias("name")).alias("c"), F.col("id").alias("element"), F.posexplode("members").alias("seg", "m"))
    parts = parts.where("m.type = 'way' AND size(m.geometry) >= 2").select("c", "element", "seg", F.col("m.geometry").alias("points"))
    return ways.unionByName(parts).select("c.class", "c.name", "element", "seg", "points")


def stitched(spark: SparkSession, path: str) -> DataFrame:
    """(name, element, ring, points) of the outer member ways of relations: ways whose start is the end so far go on with the ring,
    others begin a new one; rings of three points or fewer are dropped. Members of one relation are folded in their order."""
    e = spark.read.schema(OSM).option("multiLine", True).json(path).select(F.explode("elements").alias("e")).select("e.*").where("type = 'relation'")
    ways = F.filter("members", lambda m: (m["type"] == "way") & F.coalesce(m["role"], F.lit("")).isin("outer", "") & (F.size(m["geometry"]) > 0))
    point = "array<struct<lon:double,lat:double>>"
    start = F.struct(F.array().cast(f"array<{point}>").alias("done"), F.array().cast(point).alias("now"))

    def add(acc: Column, m: Column) -> Column:
        g = m["geometry"]
        joins = (F.size(acc["now"]) > 0) & (F.element_at(acc["now"], -1) == F.get(g, F.lit(0)))
        closed = F.when(F.size(acc["now"]) > 3, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"])
        return F.when(joins, F.struct(acc["done"].alias("done"), F.concat(acc["now"], F.slice(g, 2, F.size(g))).alias("now"))).otherwise(F.struct(closed.alias("done"), g.alias("now")))

    rings = F.aggregate(ways, start, add, lambda acc: F.when(F.size(acc["now"]) > 3, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]))
    return e.select(F.element_at("tags", F.lit("name")).alias("name"), F.col("id").alias("element"), F.posexplode(rings).alias("ring", "points"))


def is_shifted(crs: Column) -> Column:
    """True if a pack's coordinate system is moved on reading; a missing one is."""
    return F.replace(F.replace(F.upper(F.coalesce(crs, F.lit("GCJ-02"))), F.lit("-"), F.lit("")), F.lit("_"), F.lit("")).isin(SHIFTED)


def offset(lon: Column, lat: Column) -> tuple[Column, Column]:
    """The public offset of the shifted system at a point, in degrees."""
    x, y, pi = lon - 105.0, lat - 35.0, 3.14159265358979324
    wave = lambda v, *terms: sum((F.lit(a) * F.sin(v * (k * pi)) for a, k in terms), F.lit(0.0)) * (2.0 / 3.0)
    short = wave(x, (20.0, 6.0), (20.0, 2.0))
    dlat = -100.0 + 2.0 * x + 3.0 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * F.sqrt(F.abs(x)) + short + wave(y, (20.0, 1.0), (40.0, 1 / 3.0)) + wave(y, (160.0, 1 / 12.0), (320.0, 1 / 30.0))
    dlon = 300.0 + x + 2.0 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * F.sqrt(F.abs(x)) + short + wave(x, (20.0, 1.0), (40.0, 1 / 3.0)) + wave(x, (150.0, 1 / 12.0), (300.0, 1 / 30.0))
    rad = lat / 180.0 * pi
    magic = 1 - ECCENTRICITY * F.pow(F.sin(rad), 2)
    return dlon * 180.0 / (AXIS / F.sqrt(magic) * F.cos(rad) * pi), dlat * 180.0 / ((AXIS * (1 - ECCENTRICITY)) / (magic * F.sqrt(magic)) * pi)


def to_wgs(lon: Column, lat: Column, shifted: Column, places: int = 7) -> tuple[Column, Column]:
    """A point of a pack in WGS-84 with ``places`` digits if the pack is ``shifted``, else as it is."""
    dx, dy = offset(lon, lat)
    return F.when(shifted, F.bround(lon - dx, places)).otherwise(lon), F.when(shifted, F.bround(lat - dy, places)).otherwise(lat)


def from_wgs(lon: Column, lat: Column, shifted: Column, places: int = PLACES) -> tuple[Column, Column]:
    """A point in WGS-84 as a pack writes it."""
    dx, dy = offset(lon, lat)
    return F.bround(F.when(shifted, lon + dx).otherwise(lon), places), F.bround(F.when(shifted, lat + dy).otherwise(lat), places)


def normalised_ring(ring: Column, places: int = PLACES) -> Column:
    """A ring of (x, y) rounded, without repeats of the vertex before, and closed."""
    rounded = F.transform(ring, lambda p: F.struct(F.bround(p["x"], places).alias("x"), F.bround(p["y"], places).alias("y")))
    single = F.filter(rounded, lambda p, i: (i == 0) | (p != F.get(rounded, i - 1)))
    return F.when(F.element_at(single, -1) == F.get(single, F.lit(0)), single).otherwise(F.concat(single, F.slice(single, 1, 1)))


def generated_area_id(dealer: Column, component: Column) -> Column:
    """A and 8 hex digits by the dealer's name, with a suffix for later components."""
    first = F.concat(F.lit("A"), F.upper(F.substring(F.md5(dealer.cast("string").cast("binary")), 1, 8)))
    return F.when(component == 1, first).otherwise(F.concat_ws("-", first, component.cast("string")))


def violations(fences: DataFrame, stores: DataFrame, contracts: DataFrame, kinds: DataFrame) -> DataFrame:
    """(rule, region_id, name): every broken rule of packs: missing fields of fences, stores and contracts, kinds that aren't legal, stores
    without coordinates or none at all, kind totals (region_id, kind, n) that don't add up, and contracts without a fence (an orphan)."""

    def missing(df: DataFrame, rule: str, name: str, columns: list[str]) -> DataFrame:
        bad = F.explode(F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(f"{rule}.{c}")) for c in columns))))
        return df.select("region_id", F.col(name).cast("string").alias("name"), bad.alias("rule"))

    out = missing(fences, "fence", "area_id", ["area_id", "dealer", "area_km2", "rings"]).unionByName(missing(stores, "store", "name", ["name", "category", "district", "lon", "lat", "direct", "kind"])).unionByName(missing(contracts, "contract", "dealer_id", ["dealer_id", "district"]))
    row = lambda df, rule, name: df.select("region_id", F.col(name).cast("string").alias("name"), F.lit(rule).alias("rule"))
    out = out.unionByName(row(stores.where(F.col("kind").isNotNull() & ~F.col("kind").isin(KINDS)), "illegal_kind", "name"))
    out = out.unionByName(row(stores.where(F.isnan("lon") | F.isnan("lat") | ~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90)), "coordinates", "name"))
    total = kinds.groupBy("region_id").agg(F.sum("n").alias("said")).join(stores.groupBy("region_id").agg(F.count("*").alias("there")), "region_id", "full").fillna(0, ["said", "there"])
    out = out.unionByName(row(total.where("there = 0").withColumn("none", F.lit(None)), "no_stores", "none")).unionByName(row(total.where("said <> there").withColumn("none", F.lit(None)), "kind_total", "none"))
    return out.unionByName(row(contracts.join(fences.select(F.col("dealer").alias("dealer_id"), "region_id").distinct(), ["dealer_id", "region_id"], "left_anti"), "orphan_contract", "dealer_id"))
