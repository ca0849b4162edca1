"""Queries on landmarks: snapping, names, reported bounds, sides of lines, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.bindings import SIDE, X0, Y0, sql
from terrane.operators import barriers as barriers_of
from terrane.operators import landmarks as L
from terrane.operators import scenarios as S
from terrane.operators import spatial
from terrane.operators.instructions import OPPOSITE, SIDED
from terrane.plans import containment as P
from terrane.plans import scenarios
from terrane.plans.scenarios import Case
from terrane.plans.text_geometry import _case
from terrane.session import stored, table

RIVER_KM, ROAD_KM = 6.0, 8.0


def marks(spark, d):
    """(class, name, seg, pos, x, y): every third brand is a river, the others are roads."""
    return B.landmarks(spark, d).selectExpr("CASE WHEN CAST(substring(name, 7) AS INT) % 3 = 0 THEN 'river' ELSE 'road' END AS class", "name", "seg", "pos", "x", "y")


def names(spark, d):
    """(class, name): roads and rivers, numbered roads of every fifth brand, and districts."""
    m = marks(spark, d).select("class", "name").distinct()
    refs = m.where("class = 'road' AND CAST(substring(name, 7) AS INT) % 5 = 0").selectExpr("'ref' AS class", "concat('G', substring(name, 7)) AS name")
    return m.unionByName(refs).unionByName(B.units(spark, d).selectExpr("'district' AS class", "concat('区', district) AS name").distinct())


def district_squares(spark, d):
    """(district, ring) of the districts that have units."""
    n, step = B.grid(spark, d)
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    edge = lambda k, at: F.when(k == n // 10, at + SIDE).otherwise(at + k * 10 * step)
    across, up = F.expr(f"district div {n // 10}"), F.expr(f"district % {n // 10}")
    x0, x1, y0, y1 = edge(across, X0), edge(across + 1, X0), edge(up, Y0), edge(up + 1, Y0)
    squares = stored(B.units(spark, d).select("district").distinct(), "districts")  # else filters on the rings are worked out for every store
    return squares.select("district", F.array(corner(x0, y0), corner(x1, y0), corner(x1, y1), corner(x0, y1)).alias("ring"))


def in_district(points, keys, spark, d):
    """``points`` with the name of the first district that holds each, or null."""
    held = spatial.contain(points.select(*keys, "x", "y"), district_squares(spark, d), ["district"]).groupBy(*keys).agg(F.min("district").alias("k"))
    return points.join(held, keys, "left").withColumn("district", F.concat(F.lit("区"), F.col("k").cast("string"))).drop("k")


def snapped(spark, d):
    """The channel or river and the road at each store."""
    p = B.stores(spark, d).select("store_id", "x", "y")
    river, road = (L.snap(p, ["store_id"], marks(spark, d), c, r).withColumnRenamed("name", c) for c, r in (("river", RIVER_KM), ("road", ROAD_KM)))
    return p.join(river, "store_id", "left").join(road, "store_id", "left").select("store_id", F.coalesce(L.channel(F.col("x"), F.col("y")), "river").alias("river"), "road")


FENCE = ["dealer_id", "comp"]


def mains(spark, d):
    """(dealer_id, comp, main) over at most about 60 evenly spaced vertices."""
    v = B.fence_vertices(spark, d).select(*FENCE, "pos", "x", "y")
    n = v.groupBy(*FENCE).agg(F.count("*").alias("n"))
    some = v.join(n, FENCE).where("pos % greatest(1, n div 60) = 0").drop("n")
    return L.main_district(in_district(some, [*FENCE, "pos"], spark, d), FENCE)


def labels(spark, d):
    v = B.fence_vertices(spark, d)
    e = in_district(L.extremes(v, FENCE), [*FENCE, "side"], spark, d).join(mains(spark, d), FENCE, "left")
    return L.bounds(stored(e, "ends"), FENCE, stored(marks(spark, d), "marks"), RIVER_KM, ROAD_KM)


_ASK = "CASE k % 9 WHEN 0 THEN concat('Brand#', 11 + k % 40) WHEN 1 THEN concat('珠江Brand#', 11 + k % 5) WHEN 2 THEN concat('Brand#', 21 + k % 5, '路') WHEN 3 THEN concat('G', 5 * (k % 12)) WHEN 4 THEN concat('G', 1 + k % 5) WHEN 5 THEN concat('区', k % 5) WHEN 6 THEN '#3' WHEN 7 THEN 'Br外环' ELSE '无' END"


def asked(spark, d):
    return B.dealers(spark, d).selectExpr("dealer_id AS k", "cx", "cy", "h").selectExpr("k AS id", f"{_ASK} AS name", "CASE WHEN k % 4 <> 0 THEN cx END AS x", "CASE WHEN k % 4 <> 0 THEN cy END AS y")


def resolved(spark, d):
    return L.resolve(asked(spark, d), names(spark, d), marks(spark, d)).select("id", "tier", "class", "landmark")


def contract_centres(spark, d):
    """Mean vertex of the first segment of each resolved name, else the middle of the map."""
    v = marks(spark, d)
    first = v.groupBy("class", "name").agg(F.min("seg").alias("seg"))
    mean = v.join(first, ["class", "name", "seg"]).groupBy("class", F.col("name").alias("landmark")).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    found = resolved(spark, d).join(mean, ["class", "landmark"], "left")
    return asked(spark, d).select("id").join(found, "id", "left").select("id", F.round(F.coalesce("mx", F.lit(float(X0 + SIDE // 2))), 3).alias("mx"), F.round(F.coalesce("my", F.lit(float(Y0 + SIDE // 2))), 3).alias("my"))


def clause_bounds(spark, d):
    """Sides that contract sentences set: of a side's sentences the first whose name the cascade resolves."""
    t = table(spark, d, "supplier").selectExpr("s_suppkey AS k", "s_name AS a", "s_name AS b").selectExpr("k", f"{_case('contract')} AS text")
    found = F.arrays_zip(F.regexp_extract_all("text", F.lit(SIDED), F.lit(1)).alias("name"), F.regexp_extract_all("text", F.lit(SIDED), F.lit(2)).alias("w"))
    said = t.select("k", F.posexplode(found).alias("at", "f")).select("k", "at", F.replace("f.name", F.lit("Brand"), F.lit("Brand#")).alias("name"), "f.w")
    asks = said.select(F.struct("k", "at").alias("id"), "name", F.lit(None).cast("long").alias("x"), F.lit(None).cast("long").alias("y"))
    got = L.resolve(asks, names(spark, d), marks(spark, d)).select("id.k", "id.at", "landmark")
    side = F.element_at(F.create_map(*(F.lit(v) for kv in OPPOSITE.items() for v in kv)), F.col("w"))
    return said.withColumn("side", side).join(got, ["k", "at"]).groupBy("k", "side").agg(F.min_by("landmark", "at").alias("landmark"))


def costs(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey AS k", "CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS edge", "CASE p_partkey % 4 WHEN 0 THEN concat(p_brand, '路') WHEN 1 THEN 'Bronze' WHEN 2 THEN 'Xa' ELSE NULL END AS clause")
    return t.select("k", L.name_cost(F.col("edge"), F.col("clause")).alias("cost"))


_CLASSES = [*L.CLASS_RANK, "track"]


def ranks(spark, d):
    m = marks(spark, d)
    roads = m.where("class = 'road' OR pos % 50 = 0").select("name", F.get(F.array(*map(F.lit, _CLASSES)), (F.col("pos") % len(_CLASSES)).cast("int")).alias("class"))
    return L.salience(roads, m.where("class = 'river'").select("name"))


def ring_roads(spark, d):
    """Lines by name; every second one is closed by its first vertex, every seventh has a ring word."""
    m = B.landmarks(spark, d).selectExpr("CASE WHEN CAST(substring(name, 7) AS INT) % 7 = 0 THEN concat(name, '外环') ELSE name END AS name", "CAST(substring(name, 7) AS INT) AS k", "pos", "x", "y")
    first = m.where("k % 2 = 0").groupBy("name").agg(F.min_by(F.struct("x", "y"), "pos").alias("f"))
    m = m.drop("k")
    return L.closed(m.unionByName(first.select("name", F.lit(1 << 40).alias("pos"), "f.x", "f.y")))


def street_districts(spark, d):
    u = B.units(spark, d).selectExpr("street", "unit_id AS pos", "x", "y")
    return L.main_district(in_district(u, ["street", "pos"], spark, d), ["street"])


def unit_sides(c):
    """Units of each dealer and the side of the dealer's road on which they lie."""
    brands = F.array(*(F.lit(f"Brand#{k}") for k in range(1, 26)))
    own = c.sets.join(c.units.select("unit_id", "x", "y"), "unit_id").withColumn("road", F.get(brands, (F.col("dealer_id") % 25).cast("int"))).withColumn("key", F.struct("dealer_id", "unit_id"))
    lines = B.landmarks(c.spark, c.d).select(F.col("name").alias("road"), "pos", "x", "y")
    return stored(L.sides(own.select("key", "road", "x", "y"), "key", lines, "road"), "sides").select("key.dealer_id", "key.unit_id", "axis", "after")


def line_sides(spark, d):
    return unit_sides(Case(spark, d))


def along_road(spark, d):
    """The far side of its road goes to the next dealer, or to no one for every fifth; refused where a side is empty or no
    side is left. Counts of units and stores on both sides."""
    c = Case(spark, d)
    s = unit_sides(c)
    held = c.kinded.select("store_id", F.explode("dealers").alias("dealer_id")).join(c.store_units, "store_id")
    stores = held.join(s, ["dealer_id", "unit_id"]).groupBy("dealer_id").agg(F.count_if("after").alias("stores"))
    per = s.groupBy("dealer_id").agg(F.count_if("after").alias("chosen"), F.count_if(~F.col("after")).alias("other")).join(stores, "dealer_id", "left")
    status = F.when(F.col("chosen") == 0, "nothing_on_side").when(F.col("other") == 0, "all_on_side").otherwise("ok")
    return per.select("dealer_id", F.when(F.col("dealer_id") % 5 != 0, F.col("dealer_id") + 1).alias("dst"), "chosen", "other", F.coalesce("stores", F.lit(0)).alias("stores"), status.alias("status"))


def broken_lines(spark, d):
    """(dealer_id, barrier, pos, x, y): two broken lines for each dealer, twelve vertices of a landmark each, drawn round its centre."""
    v = B.landmarks(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("name", "seg").orderBy("pos")) - 1)
    n = v.groupBy("name", "seg").agg(F.count("*").alias("n"))
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    pick = B.dealers(spark, d).withColumn("k", k).selectExpr("dealer_id", "k", "cx", "cy", "h", "concat('Brand#', 1 + (dealer_id + 6 * k) % 25) AS name", "(dealer_id + k) % 4 AS seg")
    places = pick.join(n, ["name", "seg"]).withColumn("first", F.expr("(dealer_id * 7) % greatest(1, n - 11)")).withColumn("place", F.explode(F.expr("sequence(first, first + 11)")))
    met = places.join(v.withColumn("place", F.col("place").cast("long")), ["name", "seg", "place"])  # twelve places a line, not all of its vertices
    moved = lambda c, at, zero: f"{c} + floor(({at} - {zero} - 500000) * h / 250000.0D) AS {at}"
    return met.selectExpr("dealer_id", "concat(if(k = 0, '河', '路'), substring(name, 7)) AS barrier", "place AS pos", moved("cx", "x", X0), moved("cy", "y", Y0))


def split_stores(spark, d):
    """Stores of each component on the sides of two broken lines; a dealer's stores by upstream that none of its fences holds are unassigned."""
    f, s = B.fences(spark, d), B.stores(spark, d)
    lines = broken_lines(spark, d)
    barriers = f.select("dealer_id", "comp").join(lines, "dealer_id")
    placed, _ = barriers_of.split_regions(s, f, barriers, ["dealer_id", "comp"], "store_id")
    k = P.kinded(spark, d).where("upstream IS NOT NULL AND NOT array_contains(dealers, upstream)").join(B.dealers(spark, d).select(F.col("dealer_id").alias("upstream")), "upstream")
    rest = k.select("store_id", F.col("upstream").alias("dealer_id"), F.lit(None).cast("int").alias("comp"), F.lit("unassigned").alias("piece"))
    every = placed.select("store_id", "dealer_id", "comp", "piece").unionByName(rest)
    return every.groupBy("dealer_id", "comp", "piece").agg(F.count("*").alias("stores"), F.min("store_id").alias("first_store"))


def bounded_stores(spark, d):
    """Each component's stores cut by broken lines as northern and eastern bound: how many lie on the kept side of each, and within both."""
    f, lines = B.fences(spark, d), broken_lines(spark, d)
    first = F.substring("barrier", 1, 1) == "河"
    barriers = f.select("dealer_id", "comp").join(lines.withColumns({"scheme": F.when(first, "ns").otherwise("ew"), "barrier": F.when(first, "北").otherwise("东")}), "dealer_id")
    keys = ["dealer_id", "comp"]
    held = spatial.contain(B.stores(spark, d).select("store_id", "x", "y"), f, keys)
    by = barriers_of.sides(held, barriers_of.closed(f, barriers, keys), keys, "store_id").withColumn("kept", F.col("side") != F.col("barrier"))
    per = by.groupBy("store_id", *keys).agg(F.bool_or((F.col("barrier") == "北") & F.col("kept")).alias("south"), F.bool_or((F.col("barrier") == "东") & F.col("kept")).alias("west"))
    return per.groupBy(*keys).agg(F.count("*").alias("stores"), F.count_if("south").alias("south_of_bound"), F.count_if("west").alias("west_of_bound"), F.count_if(F.col("south") & F.col("west")).alias("kept"))


def halves(spark, d):
    """Units in each half of each dealer's area by both rules: from the mean on, and strictly beyond it."""
    c = Case(spark, d)
    own = c.sets.join(c.units.select("unit_id", "x", "y"), "unit_id")
    mean = own.groupBy("dealer_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    dx, dy = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    rules = {"east": dx >= 0, "west": dx < 0, "north": dy >= 0, "south": dy < 0, "strict_east": dx > 0, "strict_west": dx < 0, "strict_north": dy > 0, "strict_south": dy < 0}
    return own.join(mean, "dealer_id").groupBy("dealer_id").agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()))


def moved_stores(spark, d):
    return Case(spark, d).moved.select("proposal_id", "store_id", F.array_join(F.array_sort(F.col("new_dealers")).cast("array<string>"), ",").alias("dealers"))


def heads(spark, d):
    """The first five moved stores of each proposal."""
    m = Case(spark, d).moved.select("proposal_id", "store_id")
    return S.heads(m, "proposal_id", "store_id", 5)


QUERIES = {
    "j8_landmark_snap": snapped,
    "a23_main_district": mains,
    "j19_reported_bounds": labels,
    "j19_described_fence": lambda s, d: L.described(labels(s, d), FENCE),
    "j10_name_cascade": resolved,
    "a35_contract_centre": contract_centres,
    "p24_clause_bounds": clause_bounds,
    "p14_name_cost": costs,
    "p16_salience": ranks,
    "p19_ring_roads": ring_roads,
    "j20_street_district": street_districts,
    "j21_line_sides": line_sides,
    "r12_along_road": along_road,
    "j22_split_stores": split_stores,
    "g8_bounded_stores": bounded_stores,
    "p15_half_areas": halves,
    "j17_moved_stores": moved_stores,
    "w3_heads": heads,
}
_MARK = "SELECT CASE WHEN CAST(substr(name, 7) AS INTEGER) % 3 = 0 THEN 'river' ELSE 'road' END AS class, name, seg, pos, x, y FROM landmark"
_KM2 = "pow((p.x - m.x) / 1e6 * 102.2, 2) + pow((p.y - m.y) / 1e6 * 110.574, 2)"
_CHANNEL = "CASE " + " ".join(f"WHEN y / 1e6 BETWEEN {s} AND {n} AND x / 1e6 BETWEEN {w} AND {e} THEN '{name}'" for name, s, n, w, e in L.CHANNELS) + " END"


def _snap(points: str, key: str, kind: str, km: float) -> str:
    return f"SELECT {key}, arg_min(m.name, ({_KM2}, m.name)) AS name FROM {points} p JOIN mark m ON m.class = '{kind}' AND {_KM2} < {km} * {km} GROUP BY {key}"


def _district(points: str) -> str:
    """``points`` with the district of x, y."""
    return f"SELECT p.*, CASE WHEN x >= {X0} AND x < {X0 + SIDE} AND y >= {Y0} AND y < {Y0 + SIDE} AND k IN (SELECT district FROM unit) THEN '区' || k END AS district FROM (SELECT q.*, (least((x - {X0}) // step, n - 1) // 10) * (n // 10) + least((y - {Y0}) // step, n - 1) // 10 AS k FROM {points} q, grid) p"


_MAIN = "SELECT {k}, arg_max(district, (n, -f)) AS main FROM (SELECT {k}, district, count(*) AS n, min(pos) AS f FROM {t} WHERE district IS NOT NULL GROUP BY ALL) GROUP BY {k}"
_VD = _district("fence_vertex")
_EXT = " UNION ALL ".join(f"SELECT dealer_id, comp, '{side}' AS side, arg_max(x, ({axis} * {sign}, -pos)) AS x, arg_max(y, ({axis} * {sign}, -pos)) AS y FROM fence_vertex GROUP BY 1, 2" for side, (axis, sign) in L.SIDES.items())
_LAB = f"SELECT e.dealer_id, e.comp, e.side, coalesce({_CHANNEL.replace('y /', 'e.y /').replace('x /', 'e.x /')}, r.name, o.name, CASE WHEN district <> coalesce(main, '未知') THEN district || '区界' END, coalesce(main, '未知') || '边缘') AS label FROM endd e LEFT JOIN mains USING (dealer_id, comp) LEFT JOIN river r USING (dealer_id, comp, side) LEFT JOIN road o USING (dealer_id, comp, side)"
_EK = "p.dealer_id, p.comp, p.side"
_BOUNDS = {"mark": _MARK, "vd": _VD, "mains": _MAIN.format(k="dealer_id, comp", t="vd"), "ends": _EXT, "endd": _district("ends"), "river": _snap("ends", _EK, "river", RIVER_KM), "road": _snap("ends", _EK, "road", ROAD_KM), "lab": _LAB}
_NAMES = "SELECT DISTINCT class, name FROM mark UNION SELECT 'ref', 'G' || substr(name, 7) FROM mark WHERE class = 'road' AND CAST(substr(name, 7) AS INTEGER) % 5 = 0 UNION SELECT 'district', '区' || district FROM unit"
_ASKED = f"SELECT k AS id, {_ASK} AS name, CASE WHEN k % 4 <> 0 THEN cx END AS x, CASE WHEN k % 4 <> 0 THEN cy END AS y FROM (SELECT dealer_id AS k, cx, cy FROM dealer)"
_TIER = "SELECT a.id, a.x, a.y, n.class, n.name AS landmark, CASE WHEN n.class = 'district' THEN CASE WHEN n.name = a.name THEN 1 END WHEN n.class = 'ref' THEN CASE WHEN n.name = a.name THEN 2 WHEN contains(n.name, a.name) THEN 3 END WHEN n.name = a.name THEN CASE n.class WHEN 'river' THEN 4 ELSE 5 END WHEN n.name = replace(a.name, '珠江', '') THEN CASE n.class WHEN 'river' THEN 6 ELSE 7 END WHEN contains(n.name, a.name) OR contains(a.name, n.name) THEN 8 WHEN length(a.name) >= 2 AND (starts_with(n.name, substr(a.name, 1, 2)) OR starts_with(a.name, substr(n.name, 1, 2))) THEN 9 END AS tier FROM asked a, names n WHERE a.name <> ''"
_BEST = "SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY id) AS best FROM tiers WHERE tier IS NOT NULL) WHERE tier = best"
_FAR = "SELECT b.id, tier, b.class, landmark, CASE WHEN tier >= 8 AND b.x IS NOT NULL THEN (SELECT CAST(min((b.x - m.x) * (b.x - m.x) + (b.y - m.y) * (b.y - m.y)) AS DOUBLE) FROM mark m WHERE m.class = b.class AND m.name = b.landmark) ELSE 0 END AS d FROM best b"
_GOT = "SELECT id, min(tier) AS tier, arg_min(class, (d, class = 'river', landmark)) AS class, arg_min(landmark, (d, class = 'river', landmark)) AS landmark FROM far GROUP BY id"
_NAMED = {"mark": _MARK, "names": _NAMES, "asked": _ASKED, "tiers": _TIER, "best": _BEST, "far": _FAR, "got": _GOT}
_SAID = f"SELECT k, {_case('contract')} AS text FROM (SELECT s_suppkey AS k, s_name AS a, s_name AS b FROM supplier)"
_X = f"SELECT k, unnest(range(len(regexp_extract_all(text, '以([东南西北])')))) AS p, replace(unnest(regexp_extract_all(text, '{SIDED}', 1)), 'Brand', 'Brand#') AS name, unnest(regexp_extract_all(text, '{SIDED}', 2)) AS w FROM said"
_RING = "SELECT CASE WHEN CAST(substr(name, 7) AS INTEGER) % 7 = 0 THEN name || '外环' ELSE name END AS name, CAST(substr(name, 7) AS INTEGER) AS k, pos, x, y FROM landmark"
_ROAD = "SELECT s.dealer_id, s.unit_id, u.x, u.y, 'Brand#' || (s.dealer_id % 25 + 1) AS road FROM sets s JOIN unit u USING (unit_id)"
_AXIS = "SELECT name, CASE WHEN max(x) - min(x) >= max(y) - min(y) THEN 'y' ELSE 'x' END AS axis FROM landmark GROUP BY 1"
_SIDED = "SELECT dealer_id, unit_id, axis, CASE WHEN axis = 'y' THEN y >= ny ELSE x >= nx END AS after FROM (SELECT r.dealer_id, r.unit_id, r.road, r.x, r.y, arg_min(l.x, ((r.x - l.x) * (r.x - l.x) + (r.y - l.y) * (r.y - l.y), l.pos)) AS nx, arg_min(l.y, ((r.x - l.x) * (r.x - l.x) + (r.y - l.y) * (r.y - l.y), l.pos)) AS ny FROM road r JOIN landmark l ON l.name = r.road GROUP BY ALL) JOIN axis ON axis.name = road"
_CUT = {"sets": scenarios._SETS, "road": _ROAD, "axis": _AXIS, "sided": _SIDED}
_MEAN = "SELECT class, name, avg(x) AS mx, avg(y) AS my FROM mark JOIN (SELECT class, name, min(seg) AS seg FROM mark GROUP BY 1, 2) USING (class, name, seg) GROUP BY 1, 2"
_RANK = "CASE c " + " ".join(f"WHEN {k} THEN {L.CLASS_RANK.get(c, L.OTHER_RANK)}" for k, c in enumerate(_CLASSES)) + " END"
def _far(d: str, at: str, low: str, high: str) -> str:
    return f"CASE WHEN {d} > 0 THEN ({high} - {at}) / {d} WHEN {d} < 0 THEN ({low} - {at}) / {d} END"


def _out(name: str, x: str, y: str, bx: str, by: str) -> str:
    """Where the ray from (x, y) away from (bx, by) leaves the frame, and its place along it, as columns."""
    tx, ty = _far(f"({x} - {bx})", x, "fx0", "fx1"), _far(f"({y} - {by})", y, "fy0", "fy1")
    t = f"least(coalesce({tx}, 1e300), coalesce({ty}, 1e300))"
    return f"{x} + {t} * ({x} - {bx}) AS {name}_x, {y} + {t} * ({y} - {by}) AS {name}_y, coalesce({tx} = {t}, false) AS {name}_side"


def _turn(p: str) -> str:
    across, up = f"(({p}_x - fx0) / (fx1 - fx0))", f"(({p}_y - fy0) / (fy1 - fy0))"
    return f"CASE WHEN {p}_side AND {across} > 0.5 THEN 1 + {up} WHEN {p}_side THEN 4 - {up} WHEN {up} > 0.5 THEN 3 - {across} ELSE {across} END"


_mod = lambda a: f"(({a}) - 4 * floor(({a}) / 4))"
_round = lambda frm, to: f"list_sort(list_transform(list_filter([1, 2, 3, 4], lambda k: {_mod(f'k - {frm}')} < {_mod(f'{to} - {frm}')}), lambda k: {_mod(f'k - {frm}')}))"
_BAR = "SELECT dealer_id, CASE WHEN k = 0 THEN '河' ELSE '路' END || substr(name, 7) AS barrier, k, place, cx + floor((x - 113000000 - 500000) * h / 250000.0::DOUBLE) AS x, cy + floor((y - 22500000 - 500000) * h / 250000.0::DOUBLE) AS y FROM dealer, range(2) r(k) JOIN (SELECT *, row_number() OVER (PARTITION BY name, seg ORDER BY pos) - 1 AS place, count(*) OVER (PARTITION BY name, seg) AS n FROM landmark) l ON l.name = 'Brand#' || (1 + (dealer_id + 6 * k) % 25) AND l.seg = (dealer_id + k) % 4 WHERE place BETWEEN (dealer_id * 7) % greatest(1, n - 11) AND (dealer_id * 7) % greatest(1, n - 11) + 11"
_BLN = "SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM (SELECT * FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM bar WINDOW w AS (PARTITION BY dealer_id, k ORDER BY place)) WHERE px IS NULL OR px <> x OR py <> y) WINDOW w AS (PARTITION BY dealer_id, k ORDER BY place)"
_END = "SELECT dealer_id, k, any_value(barrier) AS barrier, arg_min(x, place) AS ax, arg_min(y, place) AS ay, arg_min(x2, place) AS ax2, arg_min(y2, place) AS ay2, arg_max(x, place) FILTER (WHERE x2 IS NOT NULL) AS bx, arg_max(y, place) FILTER (WHERE x2 IS NOT NULL) AS by_, arg_max(x2, place) FILTER (WHERE x2 IS NOT NULL) AS bx2, arg_max(y2, place) FILTER (WHERE x2 IS NOT NULL) AS by2, min(x) AS lx0, max(x) AS lx1, min(y) AS ly0, max(y) AS ly1 FROM bln GROUP BY 1, 2 HAVING bx IS NOT NULL"


def _edges(scheme: str) -> dict[str, str]:
    """Views down to cedge: the edges of the closed lines; ``scheme``: SQL of ew or ns for a row of end."""
    frame = f"SELECT e.*, comp, {scheme} AS scheme, least(x0, lx0) - 1000.0 AS fx0, greatest(x1, lx1) + 1000.0 AS fx1, least(y0, ly0) - 1000.0 AS fy0, greatest(y1, ly1) + 1000.0 AS fy1 FROM bend e JOIN (SELECT dealer_id, comp, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fence_vertex GROUP BY 1, 2) USING (dealer_id)"
    ends = f"SELECT *, {_out('start', 'ax', 'ay', 'ax2', 'ay2')}, {_out('stop', 'bx2', 'by2', 'bx', 'by_')} FROM bframe"
    turns = f"SELECT *, {_turn('start')} AS s, {_turn('stop')} AS t, CASE scheme WHEN 'ew' THEN 1.5 ELSE 2.5 END AS m FROM bout"
    ways = f"SELECT *, CASE WHEN {_mod('m - t')} < {_mod('s - t')} THEN list_transform({_round('t', 's')}, lambda v: CAST(round(v + t) AS BIGINT) % 4) ELSE list_reverse(list_transform({_round('s', 't')}, lambda v: CAST(round(v + s) AS BIGINT) % 4)) END AS way FROM bturn"
    point = lambda x, y: f"{{'x': CAST({x} AS DOUBLE), 'y': CAST({y} AS DOUBLE)}}"
    corner = point("CASE WHEN c IN (1, 2) THEN fx1 ELSE fx0 END", "CASE WHEN c IN (2, 3) THEN fy1 ELSE fy0 END")
    rest = f"SELECT dealer_id, comp, k, barrier, scheme, list_concat([{point('bx2', 'by2')}, {point('stop_x', 'stop_y')}], list_transform(way, lambda c: {corner}), [{point('start_x', 'start_y')}, {point('ax', 'ay')}]) AS rest FROM bway"
    edges = "SELECT dealer_id, comp, k, barrier, scheme, rest[i].x AS x1, rest[i].y AS y1, rest[i + 1].x AS x2, rest[i + 1].y AS y2 FROM (SELECT *, unnest(range(1, len(rest))) AS i FROM brest) UNION ALL SELECT l.dealer_id, comp, l.k, l.barrier, scheme, l.x, l.y, l.x2, l.y2 FROM bln l JOIN brest r ON r.dealer_id = l.dealer_id AND r.k = l.k WHERE l.x2 IS NOT NULL"
    sided = "SELECT h.store_id, e.dealer_id, e.comp, e.k, any_value(e.barrier) AS barrier, any_value(scheme) AS scheme, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) / (y2 - y1) * (x2 - x1)) % 2 = 1 AS odd FROM held h JOIN store USING (store_id) JOIN cedge e ON e.dealer_id = h.dealer_id AND e.comp = h.comp GROUP BY 1, 2, 3, 4"
    return {"bar": _BAR, "bln": _BLN, "bend": _END, "bframe": frame, "bout": ends, "bturn": turns, "bway": ways, "brest": rest, "cedge": edges, "sides": sided}


SQL = {
    "j8_landmark_snap": sql(f"SELECT s.store_id, coalesce({_CHANNEL}, r.name) AS river, o.name AS road FROM store s LEFT JOIN river r USING (store_id) LEFT JOIN road o USING (store_id)", mark=_MARK, river=_snap("store", "p.store_id", "river", RIVER_KM), road=_snap("store", "p.store_id", "road", ROAD_KM)),
    "a23_main_district": sql("SELECT * FROM mains", **_BOUNDS),
    "j19_reported_bounds": sql("SELECT * FROM lab", **_BOUNDS),
    "j19_described_fence": sql("SELECT dealer_id, comp, '西至' || max(label) FILTER (WHERE side = '西') || '，北至' || max(label) FILTER (WHERE side = '北') || '，东至' || max(label) FILTER (WHERE side = '东') || '，南至' || max(label) FILTER (WHERE side = '南') || '。' AS text FROM lab GROUP BY 1, 2", **_BOUNDS),
    "j10_name_cascade": sql("SELECT id, CAST(tier AS INTEGER) AS tier, class, landmark FROM got", **_NAMED),
    "a35_contract_centre": sql(f"SELECT a.id, round(coalesce(mx, {float(X0 + SIDE // 2)}), 3) AS mx, round(coalesce(my, {float(Y0 + SIDE // 2)}), 3) AS my FROM asked a LEFT JOIN got USING (id) LEFT JOIN mean m ON m.class = got.class AND m.name = landmark", **_NAMED, mean=_MEAN),
    "p24_clause_bounds": sql("SELECT id.k AS k, CASE clause.w WHEN '南' THEN '北' WHEN '北' THEN '南' WHEN '东' THEN '西' ELSE '东' END AS side, arg_min(landmark, id.p) AS landmark FROM got JOIN clause ON clause.k = id.k AND clause.p = id.p GROUP BY 1, 2", **_NAMED | {"asked": "SELECT struct_pack(k := k, p := p) AS id, name, CAST(NULL AS BIGINT) AS x, CAST(NULL AS BIGINT) AS y FROM clause"}).replace("\nmark AS (", f"\nsaid AS ({_SAID}),\nclause AS ({_X}),\nmark AS (", 1),
    "p14_name_cost": "SELECT p_partkey AS k, CASE WHEN p_partkey % 9 = 0 OR p_partkey % 4 = 3 THEN 1.0::DOUBLE WHEN p_partkey % 4 = 0 THEN 0.05::DOUBLE WHEN p_partkey % 4 = 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS cost FROM part",
    "p16_salience": sql(f"SELECT name, min({_RANK}) AS rank FROM (SELECT name, pos % {len(_CLASSES)} AS c FROM mark WHERE class = 'road' OR pos % 50 = 0) GROUP BY 1 UNION ALL SELECT DISTINCT name, 3 FROM mark WHERE class = 'river' AND name NOT IN (SELECT name FROM mark WHERE pos % 50 = 0)", mark=_MARK),
    "p19_ring_roads": sql("SELECT name, contains(name, '环') OR count(*) >= 8 AND sqrt(pow(arg_min(x, pos) - arg_max(x, pos), 2) + pow(arg_min(y, pos) - arg_max(y, pos), 2)) < 0.05 * sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2)) AS ring FROM (SELECT name, pos, x, y FROM line UNION ALL SELECT name, 1::BIGINT << 40, arg_min(x, pos), arg_min(y, pos) FROM line WHERE k % 2 = 0 GROUP BY name) GROUP BY 1", line=_RING),
    "j20_street_district": sql(_MAIN.format(k="street", t="ud"), ud=_district("(SELECT street, unit_id AS pos, x, y FROM unit)")),
    "j21_line_sides": sql("SELECT * FROM sided", **_CUT),
    "r12_along_road": sql("SELECT dealer_id, CASE WHEN dealer_id % 5 <> 0 THEN dealer_id + 1 END AS dst, chosen, other, coalesce(stores, 0) AS stores, CASE WHEN chosen = 0 THEN 'nothing_on_side' WHEN other = 0 THEN 'all_on_side' ELSE 'ok' END AS status FROM (SELECT dealer_id, count(*) FILTER (WHERE after) AS chosen, count(*) FILTER (WHERE NOT after) AS other FROM sided GROUP BY 1) LEFT JOIN (SELECT dealer_id, count(*) FILTER (WHERE after) AS stores FROM (SELECT DISTINCT store_id, dealer_id FROM held) JOIN placed USING (store_id) JOIN sided USING (dealer_id, unit_id) GROUP BY 1) USING (dealer_id)", **_CUT, placed=scenarios._AT),
    "j22_split_stores": sql("SELECT dealer_id, comp, piece, count(*) AS stores, min(store_id) AS first_store FROM (SELECT store_id, dealer_id, comp, string_agg(barrier || '-' || CASE WHEN scheme = 'ew' THEN CASE WHEN odd THEN '东' ELSE '西' END ELSE CASE WHEN odd THEN '北' ELSE '南' END END, '|' ORDER BY barrier) AS piece FROM sides GROUP BY 1, 2, 3 UNION ALL SELECT store_id, upstream, NULL, 'unassigned' FROM kinded k WHERE EXISTS (SELECT 1 FROM dealer d WHERE d.dealer_id = upstream) AND NOT EXISTS (SELECT 1 FROM held h WHERE h.store_id = k.store_id AND h.dealer_id = upstream)) GROUP BY 1, 2, 3", **_edges("CASE WHEN (ly1 - ly0) * 110.574 > (lx1 - lx0) * 102.2 THEN 'ew' ELSE 'ns' END")),
    "g8_bounded_stores": sql("SELECT dealer_id, comp, count(*) AS stores, count(*) FILTER (WHERE south) AS south_of_bound, count(*) FILTER (WHERE west) AS west_of_bound, count(*) FILTER (WHERE south AND west) AS kept FROM (SELECT store_id, dealer_id, comp, bool_or(k = 0 AND NOT odd) AS south, bool_or(k = 1 AND NOT odd) AS west FROM sides GROUP BY 1, 2, 3) GROUP BY 1, 2", **_edges("CASE WHEN k = 0 THEN 'ns' ELSE 'ew' END")),
    "p15_half_areas": sql("SELECT dealer_id, " + ", ".join(f"count(*) FILTER (WHERE {c} {o} 0) AS {n}" for n, c, o in (("east", "dx", ">="), ("west", "dx", "<"), ("north", "dy", ">="), ("south", "dy", "<"), ("strict_east", "dx", ">"), ("strict_west", "dx", "<"), ("strict_north", "dy", ">"), ("strict_south", "dy", "<"))) + " FROM (SELECT dealer_id, x - avg(x) OVER (PARTITION BY dealer_id) AS dx, y - avg(y) OVER (PARTITION BY dealer_id) AS dy FROM sets JOIN unit USING (unit_id)) GROUP BY 1", sets=scenarios._SETS),
    "j17_moved_stores": sql("SELECT proposal_id, store_id, (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT dealer_id AS x FROM kept h WHERE h.store_id = m.store_id AND h.dealer_id <> m.src UNION SELECT m.dst)) AS dealers FROM moved m", **scenarios._V),
    "w3_heads": sql("SELECT proposal_id, n, store_id FROM (SELECT proposal_id, store_id, CAST(row_number() OVER (PARTITION BY proposal_id ORDER BY store_id) AS INTEGER) AS n FROM moved) WHERE n <= 5", **scenarios._V),
}
