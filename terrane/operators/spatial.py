"""Points, rings and the cell-keyed containment join.

Rings are arrays of (x, y) in whole units, so tests are exact. A containment join keys each point by one grid cell per
level and each ring by the cells that its bounding box touches on the level that suits its width; equal keys meet in an
ordinary equi-join, which Spark may run as a broadcast, hash or sort-merge join and can split where a cell is crowded.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import scans
from terrane.session import stored

#: Width of a cell on the finest level; each further level is RATIO times as wide. Rings get the finest level on which
#: their box spans RATIO cells at most.
CELL, RATIO, LEVELS = 25_000, 8, 4
#: Pairs of a point and a site that one task of a search is to compare, and the most tasks of a round.
PAIRS, TASKS = 1 << 19, 1 << 13
#: Kilometres per degree of latitude, and of longitude at latitude 0.
KM_PER_DEGREE = 111.32
#: Kilometres per degree at the latitude of the landmarks, fixed values.
LON_KM, LAT_KM = 102.2, 110.574
#: Radius of the sphere.
EARTH_KM = 6371.0


def edges(ring: Column) -> Column:
    """The edges (x1, y1, x2, y2) of a ring, the last back to the first vertex."""
    n = F.size(ring)
    return F.transform(ring, lambda v, i: F.struct(v["x"].alias("x1"), v["y"].alias("y1"), F.get(ring, (i + 1) % n)["x"].alias("x2"), F.get(ring, (i + 1) % n)["y"].alias("y2")))


def inside(ring_edges: Column, x: Column, y: Column) -> Column:
    """Even-odd test: half-open in y, strict in x, by the sign of a cross product instead of a division."""

    def crosses(e: Column) -> Column:
        left, right = (x - e["x1"]) * (e["y2"] - e["y1"]), (y - e["y1"]) * (e["x2"] - e["x1"])
        return ((e["y1"] > y) != (e["y2"] > y)) & F.when(e["y2"] > e["y1"], left < right).otherwise(left > right)

    return F.size(F.filter(ring_edges, crosses)) % 2 == 1


def with_box(fences: DataFrame, ring: str = "ring") -> DataFrame:
    """Adds the bounding box (bx0, by0, bx1, by1) of the ring."""
    xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
    return fences.withColumns({"bx0": F.array_min(xs), "bx1": F.array_max(xs), "by0": F.array_min(ys), "by1": F.array_max(ys)})


def contain(points: DataFrame, fences: DataFrame, keys: list[str], cell: int = CELL) -> DataFrame:
    """Rows of ``points`` (x, y, ...) with the ``keys`` of each of ``fences`` (keys, ring) whose ring holds the point.

    Points with a null coordinate and rings of fewer than three vertices are in no result.
    """
    boxed = with_box(fences.where(F.size("ring") >= 3)).select(*keys, edges(F.col("ring")).alias("edges"), "bx0", "by0", "bx1", "by1")
    wide = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"))
    level = sum(((wide > cell * RATIO ** (k + 1)).cast("int") for k in range(LEVELS - 1)), F.lit(0))
    boxed = boxed.withColumn("level", level).withColumn("w", F.lit(cell) * F.pow(F.lit(RATIO), F.col("level")).cast("long"))
    down = lambda c: F.floor(F.col(c) / F.col("w"))
    filed = boxed.withColumn("kx", F.explode(F.sequence(down("bx0"), down("bx1")))).withColumn("ky", F.explode(F.sequence(down("by0"), down("by1")))).drop("w")
    keyed = points.where("x is not null and y is not null").withColumn("level", F.explode(F.array(*(F.lit(k) for k in range(LEVELS)))))
    w = F.lit(cell) * F.pow(F.lit(RATIO), F.col("level")).cast("long")
    keyed = keyed.withColumn("kx", F.floor(F.col("x") / w)).withColumn("ky", F.floor(F.col("y") / w))
    near = keyed.join(filed, ["level", "kx", "ky"]).where("x between bx0 and bx1 and y between by0 and by1")
    return near.where(inside(F.col("edges"), F.col("x"), F.col("y"))).select(*points.columns, *keys)


def centroids(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, mx, my): mean of the vertices."""
    return vertices.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))


def ring_area_km2(ring: Column, x0: int, y0: int, latitude: float) -> Column:
    """Shoelace area of a ring in micro-degrees, scaled at one latitude. Sums stay whole until the last step."""
    twice = F.aggregate(edges(ring), F.lit(0).cast("long"), lambda acc, e: acc + (e["x1"] - x0) * (e["y2"] - y0) - (e["x2"] - x0) * (e["y1"] - y0))
    return F.abs(twice) / 2.0 / 1e12 * KM_PER_DEGREE * KM_PER_DEGREE * F.cos(F.radians(F.lit(latitude)))


def _arc_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371.0) -> Column:
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column, radius: float = 6371.0) -> Column:
    """Great-circle distance between points in degrees."""
    return _arc_km(F.radians(lon1), F.radians(lat1), F.radians(lon2), F.radians(lat2), radius)


def _search(points: DataFrame, sites: DataFrame, key: str, site: str, order: list[str], by: tuple[str, ...], axes: list[str], name: str, measure: Column, most: float | None = None) -> DataFrame:
    """(key, site, ``name``): for each of ``points`` (key, by, p_axis...) the site of smallest ``measure`` among ``sites`` (site, by,
    mx, my, order, s_axis...).

    Of sites at one place (mx, my) the first in ``order`` stands for all, and points of one place are searched for once. The tasks
    of a join are set by the pairs it is expected to make: bytes of a shuffle say little, since near points compress well.
    Points meet the sites of their own and the neighbouring cells in an equi-join. ``measure`` must rise with the distance along
    the axes; a site no further than a cell is wide is final, since all others that near have been met. What is left is
    written and meets cells RATIO / 2 times as wide, until a cell spans all. The first width holds one site a cell as expected.
    ``most``: sites further away than that along the axes aren't asked for, so the search ends with cells of that width.
    """
    place = [*by, "mx", "my"]
    rest = [c for c in sites.columns if c not in place]
    first = sites.groupBy(*place).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("b"))
    sites = stored(first.select(*place, *[F.col("b")[c].alias(c) for c in rest]), "sites")
    box = sites.agg(F.count("*").alias("n"), *[f(f"s_{a}").alias(f"{w}_{a}") for a in axes for w, f in (("low", F.min), ("high", F.max))]).first()
    if not box.n:
        return points.select(key).crossJoin(sites.select(site)).withColumn(name, F.lit(0.0)).limit(0)  # no rows
    own, points = [c for c in points.columns if c != key], stored(points.distinct(), "points")
    left, group = points.select(own).distinct(), box.n  # group: the most sites that a point can meet
    if by:
        groups = sites.groupBy(*by).agg(F.count("*").alias("n"))
        left, group = left.join(groups.select(*by), list(by), "left_semi"), groups.agg(F.max("n")).first()[0]
    left = stored(left, "places")
    span = max(box[f"high_{a}"] - box[f"low_{a}"] for a in axes)
    first_width = width = (span / math.sqrt(box.n)) or 1.0
    width, out, n = width if most is None else min(width, most), None, left.count()
    while True:
        tasks = min(TASKS, math.ceil(n * group * min(1, 9 * (width / first_width) ** 2 / box.n) / PAIRS))
        cell = lambda c: F.floor(F.col(c) / width)  # noqa: B023, E731
        around = [F.struct(*[(cell(f"s_{a}") + step).alias(f"k_{a}") for a, step in zip(axes, steps, strict=True)]) for steps in itertools.product((-1, 0, 1), repeat=len(axes))]
        filed = sites.withColumn("_k", F.explode(F.array(*around))).select(*sites.columns, "_k.*")
        cells = [f"k_{a}" for a in axes]
        asked = left.withColumns({f"k_{a}": cell(f"p_{a}") for a in axes})
        if tasks > 1:
            asked = asked.repartition(max(tasks, sites.sparkSession.sparkContext.defaultParallelism), *cells, *by)
        near = asked.join(filed, [*cells, *by], "left")
        gap = sum((F.pow(F.col(f"p_{a}") - F.col(f"s_{a}"), 2) for a in axes), F.lit(0.0))
        near = near.withColumns({name: measure.cast("double"), "_gap": gap})
        met = near.groupBy(*own).agg(F.min_by(F.struct(site, name, "_gap"), F.when(F.col(name).isNotNull(), F.struct(name, *order))).alias("b"))
        met = stored(met.select(*own, f"b.{site}", f"b.{name}", "b._gap"), "nearest")
        last = most is not None and width >= most
        final = F.lit(True) if last else F.coalesce(F.col("_gap") <= width * width, F.lit(False))
        done = met.where(final).select(*own, site, name)
        out = done if out is None else out.unionByName(done)
        left = met.where(~final).select(own)
        n = 0 if last else left.count()
        if not n:
            return points.join(out, own).select(key, site, name)
        width = width * (RATIO // 2) if most is None else min(width * (RATIO // 2), most)


def nearest(points: DataFrame, sites: DataFrame, key: str, site: str, order: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(key, site, d2): for each of ``points`` (key, x, y) the nearest of ``sites`` (site, mx, my, order) by planar squared distance.

    Ties go to the first in ``order``. Points without coordinates have no answer. ``by``: columns of both in which a point and
    its site must be equal; points without such a site have no answer.
    """
    at = points.where("x IS NOT NULL AND y IS NOT NULL").select(key, *by, F.col("x").alias("p_x"), F.col("y").alias("p_y"))
    known = sites.withColumns({"s_x": F.col("mx"), "s_y": F.col("my")})
    dx, dy = F.col("p_x") - F.col("s_x"), F.col("p_y") - F.col("s_y")
    return _search(at, known, key, site, order, by, ["x", "y"], "d2", dx * dx + dy * dy)


def nearest_km(points: DataFrame, sites: DataFrame, key: str, site: str, order: list[str], by: tuple[str, ...] = (), flat: bool = False) -> DataFrame:
    """(key, site, km): as :func:`nearest`, for micro-degrees on the sphere: by great-circle distance anywhere on it, or, if
    ``flat``, on the plane of the landmarks' latitude.

    On the sphere cells are cubes round unit vectors times the radius. A chord is shorter than its arc and rises with it, so the
    cell bound holds for the arc: a site not met yet is more than a cell's width away along the chord.
    """
    points = points.where("x IS NOT NULL AND y IS NOT NULL")
    degrees = lambda c: F.col(c) / 1e6
    if flat:
        at = points.select(key, *by, (degrees("x") * LON_KM).alias("p_x"), (degrees("y") * LAT_KM).alias("p_y"))
        known = sites.withColumns({"s_x": degrees("mx") * LON_KM, "s_y": degrees("my") * LAT_KM})
        return _search(at, known, key, site, order, by, ["x", "y"], "km", F.hypot(F.col("p_x") - F.col("s_x"), F.col("p_y") - F.col("s_y")))

    def vector(lon: Column, lat: Column, mark: str) -> dict[str, Column]:
        lon, lat = F.radians(lon), F.radians(lat)
        return {f"{mark}_u": EARTH_KM * F.cos(lat) * F.cos(lon), f"{mark}_v": EARTH_KM * F.cos(lat) * F.sin(lon), f"{mark}_w": EARTH_KM * F.sin(lat), f"{mark}_lon": lon, f"{mark}_lat": lat}

    at = points.select(key, *by, *[v.alias(k) for k, v in vector(degrees("x"), degrees("y"), "p").items()])
    known = sites.withColumns(vector(degrees("mx"), degrees("my"), "s"))
    return _search(at, known, key, site, order, by, ["u", "v", "w"], "km", _arc_km(*(F.col(c) for c in ("p_lon", "p_lat", "s_lon", "s_lat"))))


def km2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared kilometres between points in micro-degrees, on a plane at one latitude."""
    return F.pow((x1 - x2) / 1e6 * LON_KM, 2) + F.pow((y1 - y2) / 1e6 * LAT_KM, 2)


def nearest_within(points: DataFrame, sites: DataFrame, key: str, site: str, radius_km: float) -> DataFrame:
    """(key, site, d2): for each of ``points`` (key, x, y) the nearest of ``sites`` (site, mx, my) less than ``radius_km`` away, by
    :func:`km2`, of equally near ones the first. Points without one have no row."""
    at = points.where("x IS NOT NULL AND y IS NOT NULL").select(key, "x", "y", (F.col("x") / 1e6 * LON_KM).alias("p_x"), (F.col("y") / 1e6 * LAT_KM).alias("p_y"))
    known = sites.withColumns({"s_x": F.col("mx") / 1e6 * LON_KM, "s_y": F.col("my") / 1e6 * LAT_KM})
    found = _search(at, known, key, site, [site], (), ["x", "y"], "d2", km2(F.col("x"), F.col("y"), F.col("mx"), F.col("my")), radius_km)
    return found.where(F.col("d2") < radius_km * radius_km)


def within(points: DataFrame, sites: DataFrame, radius_km: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of ``points`` (x, y, ...) with every row of ``sites`` (mx, my, ...) less than ``radius_km`` away, and their d2 in
    square kilometres. They meet by cells as wide as the radius; ``by``: columns of both that must be equal."""
    width = math.ceil(radius_km / min(LON_KM, LAT_KM) * 1e6)
    cell = lambda c: F.floor(F.col(c) / width)
    around = F.explode(F.array(*(F.struct((cell("mx") + dx).alias("kx"), (cell("my") + dy).alias("ky")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    filed = sites.withColumn("k", around).select(*sites.columns, "k.kx", "k.ky")
    near = points.withColumns({"kx": cell("x"), "ky": cell("y")}).join(filed, ["kx", "ky", *by]).drop("kx", "ky")
    return near.withColumn("d2", km2(F.col("x"), F.col("y"), F.col("mx"), F.col("my"))).where(F.col("d2") < radius_km * radius_km)


def clip_half_plane(polygons: DataFrame, key: str) -> DataFrame:
    """(key, n, x, y): vertices of each ring of ``polygons`` (key, ring, px, py, nx, ny) on the side of its line where
    (v - p) . n >= 0, in order; an edge gives its end if that is kept and its crossing if it crosses."""
    side = lambda x, y: (x - F.col("px")) * F.col("nx") + (y - F.col("py")) * F.col("ny")

    def cut(e: Column) -> Column:
        a, b = side(e["x1"], e["y1"]), side(e["x2"], e["y2"])
        t = a / F.when(a != b, a - b)
        crossing = F.struct((e["x1"] + t * (e["x2"] - e["x1"])).cast("double").alias("x"), (e["y1"] + t * (e["y2"] - e["y1"])).cast("double").alias("y"))
        end = F.struct(e["x2"].cast("double").alias("x"), e["y2"].cast("double").alias("y"))
        return F.when((a >= 0) & (b >= 0), F.array(end)).when((a >= 0) & (b < 0), F.array(crossing)).when((a < 0) & (b >= 0), F.array(crossing, end)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))

    return polygons.select(key, F.posexplode(F.flatten(F.transform(edges(F.col("ring")), cut))).alias("n", "v")).select(key, "n", "v.x", "v.y")


def fit_line(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, by_x, slope, px, py, nx, ny): least-squares line through each group of ``points`` (keys, x, y), free along the axis
    of larger variance (by_x: y as a function of x), with a point on it and its unit normal, which points north or east."""
    f = points.groupBy(*keys).agg(F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"), F.avg("x").alias("px"), F.avg("y").alias("py"))
    wide = F.greatest("vx", "vy")
    f = f.withColumns({"by_x": F.col("vx") >= F.col("vy"), "slope": F.when(wide > 0, F.col("c") / wide).otherwise(0.0)})
    norm = F.sqrt(1 + F.col("slope") * F.col("slope"))
    return f.select(*keys, "by_x", "slope", "px", "py", (F.when(F.col("by_x"), -F.col("slope")).otherwise(1.0) / norm).alias("nx"), (F.when(F.col("by_x"), 1.0).otherwise(-F.col("slope")) / norm).alias("ny"))


def running_length(lines: DataFrame, keys: list[str], order: str, rows: int = scans.ROWS) -> DataFrame:
    """Adds ``along``: the length of the line up to each vertex of ``lines`` (keys, order, x, y), the order a number. Ranges of it of
    about ``rows`` vertices are worked on apart, so one line may have any number of them."""
    ranged, span = scans.ranged(lines, order, rows)
    ranged = scans.running(ranged, keys, [order], span, {"_b": ("max", F.struct(order, F.col("x").alias("px"), F.col("y").alias("py")), False)})
    step = F.coalesce(F.hypot(F.col("x") - F.col("_b.px"), F.col("y") - F.col("_b.py")), F.lit(0.0))
    return scans.running(ranged, keys, [order], span, {"along": ("sum", step, True)}).select(*lines.columns, "along")


def resample(lines: DataFrame, keys: list[str], order: str, step: float) -> DataFrame:
    """(keys, k, x, y): points every ``step`` along each line, the first vertex included, by linear interpolation."""
    w = Window.partitionBy(*keys).orderBy(order)
    run = running_length(lines, keys, order)
    spans = run.select(*keys, "x", "y", "along", F.lead("along").over(w).alias("to"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("to > along")
    k0, k1 = F.ceil(F.col("along") / step), F.ceil(F.col("to") / step) - 1
    points = spans.where(k0 <= k1).withColumn("k", F.explode(F.sequence(k0, k1)))
    share = (F.col("k") * step - F.col("along")) / (F.col("to") - F.col("along"))
    return points.select(*keys, "k", (F.col("x") + share * (F.col("x2") - F.col("x"))).alias("x"), (F.col("y") + share * (F.col("y2") - F.col("y"))).alias("y"))
