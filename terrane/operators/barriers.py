"""Sides of broken lines: regions split along barriers by the parity of crossings.

A barrier is a broken line across a region. Its two ends are drawn on to the edge of a frame round region and line, and the
line is closed along the frame, through the frame's eastern or northern edge. Then a point is on the eastern (northern) side
if a ray from it crosses the closed line an odd number of times, however often the line turns or crosses itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.spatial import LAT_KM, LON_KM, contain, with_box

#: Rows of cells that a frame is cut into.
BANDS = 32
#: Labels of the side through which a line is closed, and of the other one.
LABELS = {"ew": ("东", "西"), "ns": ("北", "南")}


def closed(regions: DataFrame, barriers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, barrier, scheme, fy0, band, x1, y1, x2, y2): edges of each barrier's closed line, with the frame's foot and the width of its
    bands. ``regions``: (keys, ring); ``barriers``: (keys, barrier, pos, x, y) and, if it is to be given, scheme (ew or ns).

    Without it a line that reaches further from north to south divides east from west. Barriers of fewer than two different
    vertices are left out.
    """
    names = [*keys, "barrier"]
    given = F.max("scheme") if "scheme" in barriers.columns else F.lit(None).cast("string")
    w = Window.partitionBy(*names).orderBy("pos")
    v = barriers.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).where("px IS NULL OR px <> x OR py <> y").select(*barriers.columns)
    line = v.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w)})
    ends = line.groupBy(*names).agg(
        F.min_by(F.struct("x", "y", "x2", "y2"), "pos").alias("a"), F.max_by(F.struct("x", "y", "x2", "y2"), F.when(F.col("x2").isNotNull(), F.col("pos"))).alias("b"),
        F.min("x").alias("lx0"), F.max("x").alias("lx1"), F.min("y").alias("ly0"), F.max("y").alias("ly1"), given.alias("given"),
    ).where("b IS NOT NULL")
    box = with_box(regions).groupBy(*keys).agg(F.min("bx0").alias("x0"), F.max("bx1").alias("x1"), F.min("by0").alias("y0"), F.max("by1").alias("y1"))
    f = ends.join(box, keys)
    pad = F.lit(1000.0)
    f = f.select(*names, "a", "b", F.coalesce("given", F.when((F.col("ly1") - F.col("ly0")) * LAT_KM > (F.col("lx1") - F.col("lx0")) * LON_KM, "ew").otherwise("ns")).alias("scheme"), (F.least("x0", "lx0") - pad).alias("fx0"), (F.greatest("x1", "lx1") + pad).alias("fx1"), (F.least("y0", "ly0") - pad).alias("fy0"), (F.greatest("y1", "ly1") + pad).alias("fy1"))

    def out(x: str, y: str, back_x: str, back_y: str) -> Column:
        """Where the ray from (x, y) away from (back_x, back_y) leaves the frame."""
        dx, dy = F.col(x) - F.col(back_x), F.col(y) - F.col(back_y)
        far = lambda d, at, low, high: F.when(d > 0, (F.col(high) - F.col(at)) / F.when(d != 0, d)).when(d < 0, (F.col(low) - F.col(at)) / F.when(d != 0, d))
        t = F.least(far(dx, x, "fx0", "fx1"), far(dy, y, "fy0", "fy1"))  # the first edge met; null for none
        return F.struct((F.col(x) + t * dx).alias("x"), (F.col(y) + t * dy).alias("y"), (far(dx, x, "fx0", "fx1") == t).alias("side"))

    f = f.withColumns({"start": out("a.x", "a.y", "a.x2", "a.y2"), "stop": out("b.x2", "b.y2", "b.x", "b.y")})

    def turn(p: str) -> Column:
        """Place of an end along the frame: 0 to 4 from the south-western corner, eastwards first."""
        across, up = (F.col(f"{p}.x") - F.col("fx0")) / (F.col("fx1") - F.col("fx0")), (F.col(f"{p}.y") - F.col("fy0")) / (F.col("fy1") - F.col("fy0"))
        side = F.coalesce(F.col(f"{p}.side"), F.lit(False))
        return F.when(side & (across > 0.5), 1 + up).when(side, 4 - up).when(up > 0.5, 3 - across).otherwise(across)

    f = f.withColumns({"s": turn("start"), "t": turn("stop")})
    through = F.when(F.col("scheme") == "ew", 1.5).otherwise(2.5)
    ahead = lambda k, frm: F.pmod(k - frm, F.lit(4.0))
    onward = ahead(through, F.col("t")) < ahead(F.col("s"), F.col("t"))  # eastwards round from the stop to the start
    corner = lambda k, x, y: F.struct(F.lit(float(k)).alias("k"), F.col(x).alias("x"), F.col(y).alias("y"))
    corners = F.array(corner(1, "fx1", "fy0"), corner(2, "fx1", "fy1"), corner(3, "fx0", "fy1"), corner(4, "fx0", "fy0"))
    between = lambda frm, to: F.filter(corners, lambda c: ahead(c["k"], frm) < ahead(to, frm))
    sort = lambda cs, frm: F.transform(F.array_sort(F.transform(cs, lambda c: F.struct(ahead(c["k"], frm).alias("k"), c["x"].alias("x"), c["y"].alias("y")))), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    way = F.when(onward, sort(between(F.col("t"), F.col("s")), F.col("t"))).otherwise(F.reverse(sort(between(F.col("s"), F.col("t")), F.col("s"))))
    xy = lambda p, x="x", y="y": F.struct(F.col(f"{p}.{x}").cast("double").alias("x"), F.col(f"{p}.{y}").cast("double").alias("y"))
    rest = F.concat(F.array(xy("b", "x2", "y2"), xy("stop")), way, F.array(xy("start"), xy("a")))  # from the last vertex round to the first
    f = f.withColumns({"rest": rest, "band": (F.col("fy1") - F.col("fy0")) / BANDS})
    frame = [*names, "scheme", "fy0", "band"]
    pairs = F.transform(F.slice("rest", 1, F.size("rest") - 1), lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(F.col("rest"), i + 1)["x"].alias("x2"), F.get(F.col("rest"), i + 1)["y"].alias("y2")))
    own = line.where("x2 IS NOT NULL").select(*names, *[F.col(c).cast("double").alias(n) for c, n in (("x", "x1"), ("y", "y1"), ("x2", "x2"), ("y2", "y2"))]).join(f.select(frame), names)
    return own.select(*frame, "x1", "y1", "x2", "y2").unionByName(f.select(*frame, F.explode(pairs).alias("e")).select(*frame, "e.*"))


def sides(points: DataFrame, edges: DataFrame, keys: list[str], key: str) -> DataFrame:
    """(key, keys, barrier, side): the label of the side on which each of ``points`` (key, keys, x, y) lies of each barrier of its
    region. ``edges``: from :func:`closed`. Points and edges meet by bands of the frame, so a long line is met piece by piece."""
    names = [*keys, "barrier"]
    per = edges.select(*names, "scheme", "fy0", "band").distinct()
    asked = points.select(key, *keys, "x", "y").join(per, keys).withColumn("k", F.floor((F.col("y") - F.col("fy0")) / F.col("band")))
    row = lambda y: F.floor((y - F.col("fy0")) / F.col("band"))
    filed = edges.withColumn("k", F.explode(F.sequence(row(F.least("y1", "y2")), row(F.greatest("y1", "y2"))))).select(*names, "k", "x1", "y1", "x2", "y2")
    met = asked.join(filed, [*names, "k"], "left")
    crossing = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) / F.when(F.col("y2") != F.col("y1"), F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    odd = F.count_if(F.coalesce(crossing, F.lit(False))) % 2 == 1
    label = F.coalesce(*[F.when(F.col("scheme") == s, F.when(F.col("odd"), one).otherwise(two)) for s, (one, two) in LABELS.items()])
    return met.groupBy(key, *names, "scheme").agg(odd.alias("odd")).select(key, *names, label.alias("side"))


def split_regions(points: DataFrame, regions: DataFrame, barriers: DataFrame, keys: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """(placed, problems) of ``points`` (key, x, y) in ``regions`` (keys, ring) cut by ``barriers``.

    placed: (key, keys, piece): for each region that holds the point, its sides of all the region's barriers by name, as one
    text. problems: (keys, problem): regions without a barrier that can cut (no_barrier). Points in no region are in neither.
    """
    edges = closed(regions, barriers, keys)
    held = contain(points.select(key, "x", "y"), regions, keys)
    by = sides(held, edges, keys, key)
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("barrier", "side"))), lambda s: F.concat(s["barrier"], F.lit("-"), s["side"])), "|")  # a region's barriers
    problems = regions.select(*keys).distinct().join(edges.select(*keys).distinct(), keys, "left_anti").withColumn("problem", F.lit("no_barrier"))
    return by.groupBy(key, *keys).agg(piece.alias("piece")), problems
