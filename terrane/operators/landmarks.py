"""Landmarks: snapping points to rivers and roads, names to landmarks, reported bounds of a fence, sides of a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.containment_index import contained
from terrane.operators.rules import lookup
from terrane.operators.spatial import nearest, nearest_within

# Channels by box (south, north, west, east in degrees), the first that holds a point counts.
CHANNELS = [
    ("珠江前航道", 23.096, 23.140, 113.230, 113.490),
    ("珠江后航道", 23.048, 23.102, 113.195, 113.450),
    ("珠江西航道", 23.090, 23.175, 113.150, 113.330),
]
# How salient a road class is, and a river.
CLASS_RANK = {
    "motorway": 0, "motorway_link": 1, "trunk": 1, "trunk_link": 2, "primary": 2, "primary_link": 3, "secondary": 3,
    "secondary_link": 4, "tertiary": 4, "tertiary_link": 5, "residential": 6, "unclassified": 7, "service": 8,
}
OTHER_RANK, RIVER_RANK = 7, 3
DROPPED = "珠江"
#: Words in the name of a ring road.
RING_WORDS = ["环", "绕城"]
#: Tiers of the name cascade.
TIERS = ["district", "ref", "part_of_ref", "river", "road", "river_short", "road_short", "contained", "prefix"]
SIDES = {"北": ("y", 1), "南": ("y", -1), "东": ("x", 1), "西": ("x", -1)}


def channel(x: Column, y: Column) -> Column:
    """The channel whose box holds a point in micro-degrees, or null."""
    return F.coalesce(*(F.when((y / 1e6).between(s, n) & (x / 1e6).between(w, e), name) for name, s, n, w, e in CHANNELS))


def snap(points: DataFrame, keys: list[str], marks: DataFrame, kind: str, radius_km: float) -> DataFrame:
    """(keys, name): for each of ``points`` (keys, x, y) the landmark of ``kind`` with the nearest vertex less than
    ``radius_km`` away; of equal ones the first by name. ``marks``: (class, name, x, y)."""
    sites = marks.where(F.col("class") == kind).select("name", F.col("x").alias("mx"), F.col("y").alias("my"))
    found = nearest_within(points.select(F.struct(*keys).alias("point"), "x", "y"), sites, "point", "name", radius_km)
    return found.select(*(F.col(f"point.{k}").alias(k) for k in keys), "name")


def resolve(asked: DataFrame, names: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, tier, class, landmark) of each of ``asked`` (id, name, x, y) that the cascade resolves.

    In order: the name of a district, of a numbered road, a part of such a number, of a river, of a road; without the
    dropped word of a river, of a road; roads and rivers whose name is a part of the asked one or has it as a part; those that
    start with the same two characters. In the last two tiers the landmark nearest to (x, y) counts, roads before rivers and
    then by name where there is no difference or no point. ``names``: (class, name) of districts, refs, rivers and roads;
    ``vertices``: (class, name, x, y). Null and empty names resolve to nothing.
    """
    asked = asked.where("length(name) > 0").select("id", "name", "x", "y")
    words, known = asked.select("name").distinct(), names.where("length(name) > 0").select("class", F.col("name").alias("landmark")).distinct()
    lines = known.where("class IN ('river', 'road')")

    def tiered(found: DataFrame, tier: Column) -> DataFrame:
        return found.select("name", tier.cast("int").alias("tier"), "class", "landmark")

    exact = words.join(known, words["name"] == known["landmark"])
    tiers = tiered(exact, lookup({"district": 1, "ref": 2, "river": 4, "road": 5}, F.col("class")))
    refs = contained(words, known.where("class = 'ref'"), "name", "landmark").groupBy("name").agg(F.min("landmark").alias("landmark"))
    tiers = tiers.unionByName(tiered(refs.withColumn("class", F.lit("ref")), F.lit(3)))
    short = words.withColumn("landmark", F.replace("name", F.lit(DROPPED), F.lit(""))).join(lines, "landmark")
    tiers = tiers.unionByName(tiered(short, lookup({"river": 6, "road": 7}, F.col("class"))))
    inside = contained(words, lines, "name", "landmark").join(lines, "landmark")
    around = contained(lines, words, "landmark", "name").join(lines, "landmark")
    tiers = tiers.unionByName(tiered(inside, F.lit(8))).unionByName(tiered(around, F.lit(8)))
    start = words.where("length(name) >= 2").select("name", F.explode(F.array(F.substring("name", 1, 2), F.substring("name", 1, 1))).alias("start"))
    alike = start.join(lines.withColumn("start", F.substring("landmark", 1, 2)), "start")
    tiers = tiers.unionByName(tiered(alike, F.lit(9))).distinct()

    best = tiers.withColumn("best", F.min("tier").over(Window.partitionBy("name"))).where("tier = best").drop("best")
    found = asked.join(best, "name")
    first = F.struct((F.col("class") == "river").alias("river"), "landmark")
    sure = found.where("tier < 8 OR x IS NULL").groupBy("id", "tier").agg(F.min(first).alias("f"), F.min_by("class", first).alias("class")).select("id", "tier", "class", "f.landmark")
    asks = found.where("tier >= 8 AND x IS NOT NULL").select(F.struct("id", "tier", "class", "landmark").alias("key"), "class", "landmark", "x", "y").distinct()
    sites = vertices.select("class", F.col("name").alias("landmark"), F.col("x").alias("mx"), F.col("y").alias("my"), F.lit(0).alias("site"))
    near = nearest(asks, sites, "key", "site", [], by=("class", "landmark"))
    near = near.groupBy("key.id", "key.tier").agg(F.min_by(F.struct("key.class", "key.landmark"), F.struct("d2", F.col("key.class") == "river", "key.landmark")).alias("f"))
    return sure.unionByName(near.select("id", "tier", "f.class", "f.landmark"))


def extremes(rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, x, y): the first vertex of ``rings`` (keys, pos, x, y) that lies furthest to each side."""
    at = [F.struct(F.lit(side).alias("side"), F.max_by(F.struct("x", "y"), F.struct(F.col(axis) * sign, -F.col("pos"))).alias("v")) for side, (axis, sign) in SIDES.items()]
    return rings.groupBy(*keys).agg(F.array(*at).alias("e")).select(*keys, F.explode("e").alias("e")).select(*keys, "e.side", "e.v.x", "e.v.y")


def main_district(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, main): the commonest district of ``points`` (keys, pos, district), of equal ones the first met. Null ones don't count."""
    per = points.where("district IS NOT NULL").groupBy(*keys, "district").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return per.groupBy(*keys).agg(F.max_by("district", F.struct("n", -F.col("first"))).alias("main"))


def bounds(ends: DataFrame, keys: list[str], marks: DataFrame, river_km: float, road_km: float) -> DataFrame:
    """(keys, side, label) of ``ends`` (keys, side, x, y, district, main): the channel or river there, else the road, else the
    border of a neighbouring district, else the edge of the fence's own."""
    on = [*keys, "side"]
    river = snap(ends, on, marks, "river", river_km).withColumnRenamed("name", "river")
    road = snap(ends, on, marks, "road", road_km).withColumnRenamed("name", "road")
    main = F.coalesce("main", F.lit("未知"))
    neighbour = F.when(F.col("district").isNotNull() & (F.col("district") != main), F.concat("district", F.lit("区界")))
    label = F.coalesce(channel(F.col("x"), F.col("y")), "river", "road", neighbour, F.concat(main, F.lit("边缘")))
    return ends.join(river, on, "left").join(road, on, "left").select(*on, label.alias("label"))


def described(labels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the four labels of (keys, side, label) as one sentence."""
    wide = labels.groupBy(*keys).pivot("side", list(SIDES)).agg(F.first("label"))
    return wide.select(*keys, F.concat(F.lit("西至"), "西", F.lit("，北至"), "北", F.lit("，东至"), "东", F.lit("，南至"), "南", F.lit("。")).alias("text"))


def name_cost(edge: Column, clause: Column) -> Column:
    """0.05 if one name contains the other, 0.5 if both start with the same two characters, else 1; 1 for missing names."""
    missing = (F.length(F.coalesce(edge, F.lit(""))) == 0) | (F.length(F.coalesce(clause, F.lit(""))) == 0)
    same = (F.length(edge) >= 2) & (F.length(clause) >= 2) & (F.substring(edge, 1, 2) == F.substring(clause, 1, 2))
    return F.when(missing, 1.0).when(F.contains(edge, clause) | F.contains(clause, edge), 0.05).when(same, 0.5).otherwise(1.0)


def salience(roads: DataFrame, rivers: DataFrame) -> DataFrame:
    """(name, rank): the least rank of a name's road classes (name, class), or a river's (name) where no road has the name."""
    own = roads.where("length(name) > 0").groupBy("name").agg(F.min(F.coalesce(lookup(CLASS_RANK, F.col("class")), F.lit(OTHER_RANK))).alias("rank"))
    return own.unionByName(rivers.where("length(name) > 0").select("name").distinct().join(own, "name", "left_anti").withColumn("rank", F.lit(RIVER_RANK)))


def closed(lines: DataFrame, words: list[str] = RING_WORDS) -> DataFrame:
    """(name, ring): a name with a ring word, or a line of 8 vertices or more whose ends are nearer than 5 % of its box's diagonal.
    ``lines``: (name, pos, x, y)."""
    point = F.struct("x", "y")
    ends = lines.groupBy("name").agg(F.count("*").alias("n"), F.min_by(point, "pos").alias("a"), F.max_by(point, "pos").alias("b"), F.hypot(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("diagonal"))
    named = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains("name", w))
    gap = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y"))
    return ends.select("name", (named | ((F.col("n") >= 8) & (gap < 0.05 * F.col("diagonal")))).alias("ring"))


def sides(points: DataFrame, key: str, lines: DataFrame, line: str) -> DataFrame:
    """(key, line, axis, after): on which side of its line each of ``points`` (key, line, x, y) lies, by the nearest vertex of
    ``lines`` (line, pos, x, y). Lines that span more of x than of y part north from south (axis y), others east from west;
    after: at or beyond the vertex on that axis."""
    span = lines.groupBy(line).agg(F.when(F.max("x") - F.min("x") >= F.max("y") - F.min("y"), "y").otherwise("x").alias("axis"))
    sites = lines.select(line, F.struct("x", "y").alias("site"), "pos", F.col("x").alias("mx"), F.col("y").alias("my"))
    near = nearest(points, sites, key, "site", ["pos"], by=(line,)).select(key, "site")
    j = points.join(near, key).join(span, line)
    return j.select(key, line, "axis", F.when(F.col("axis") == "y", F.col("y") >= F.col("site.y")).otherwise(F.col("x") >= F.col("site.x")).alias("after"))
