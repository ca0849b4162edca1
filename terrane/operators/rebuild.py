"""Fences rebuilt from contract lines: a ring from four bounds, and a region cut by its bounds one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.spatial import clip_half_plane, nearest
from terrane.session import stored

#: Sides in the order in which a ring passes them, and the neighbour that each meets at its end.
RING = ["西", "南", "东", "北"]
NEXT = {"西": "南", "南": "东", "东": "北", "北": "西"}
#: Sides in the order in which they cut, and on which side of its line a region stays.
CUTS = ["北", "南", "东", "西"]


def corners(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(one, two, x, y): for each of ``pairs`` (one, two) of line names the middle of their nearest vertices, of equal ones the
    first on the first line, then on the second. ``lines``: (name, pos, x, y)."""
    pairs = pairs.distinct().withColumn("pair", F.struct("one", "two"))
    first = lines.withColumnRenamed("name", "one").join(pairs, "one").select(F.struct("pair", F.col("pos").alias("p")).alias("key"), "pair", "x", "y")
    second = lines.withColumnRenamed("name", "two").join(pairs, "two").select("pair", F.col("x").alias("mx"), F.col("y").alias("my"), "pos", F.struct("x", "y").alias("site"))
    first = stored(first, "vertices")
    met = nearest(first, second, "key", "site", ["pos"], by=("pair",)).join(first, "key")
    best = met.groupBy("pair").agg(F.min_by(F.struct("x", "y", "site"), F.struct("d2", "key.p")).alias("b"))
    return best.select("pair.one", "pair.two", ((F.col("b.x") + F.col("b.site.x")) / 2).alias("x"), ((F.col("b.y") + F.col("b.site.y")) / 2).alias("y"))


def from_bounds(contracts: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rings, problems) of ``contracts`` (id, side, name) with the names of the lines on up to four sides.

    Neighbouring lines meet at the middle of their nearest vertices; of each line the stretch between its vertices nearest to
    its two corners is kept, and the stretches follow each other west, south, east, north. rings: (id, pos, x, y) without
    repeats of the vertex before and not closed. problems: (id, lines, problem): too_few_lines (under three of two vertices
    or more) or side_missing.
    """
    known = lines.groupBy("name").agg(F.count("*").alias("n")).where("n >= 2").select("name")
    usable = contracts.join(known, "name")
    counts = contracts.select("id").distinct().join(usable.groupBy("id").agg(F.count_distinct("side").alias("lines")), "id", "left").select("id", F.coalesce("lines", F.lit(0)).alias("lines"))
    problems = counts.where("lines < 4").select("id", "lines", F.when(F.col("lines") < 3, "too_few_lines").otherwise("side_missing").alias("problem"))
    whole = usable.join(counts.where("lines = 4"), "id").select("id", "side", "name")
    after = F.element_at(F.create_map(*(F.lit(v) for kv in NEXT.items() for v in kv)), F.col("side"))
    pairs = stored(whole.withColumn("next", after).join(whole.select("id", F.col("side").alias("next"), F.col("name").alias("two")), ["id", "next"]).select("id", "side", "next", F.col("name").alias("one"), "two"), "pairs")
    met = pairs.join(corners(pairs.select("one", "two"), lines), ["one", "two"])
    ends = met.select("id", "side", F.lit(True).alias("last"), "x", "y").unionByName(met.select("id", F.col("next").alias("side"), F.lit(False).alias("last"), "x", "y"))
    at = ends.join(whole, ["id", "side"]).select("id", "side", "name", "last", F.struct("id", "side", "last").alias("key"), "x", "y")
    at = stored(at, "ends")
    sites = lines.select("name", "pos", F.col("pos").alias("site"), F.col("x").alias("mx"), F.col("y").alias("my"))
    found = nearest(at, sites, "key", "site", ["pos"], by=("name",)).select("key", "site").join(at.select("key", "id", "side", "name", "last"), "key")
    span = found.groupBy("id", "side", "name").agg(F.max(F.when(~F.col("last"), F.col("site"))).alias("a"), F.max(F.when(F.col("last"), F.col("site"))).alias("b"))
    v = span.join(lines, "name").where("pos BETWEEN least(a, b) AND greatest(a, b)")
    order = F.array_position(F.array(*map(F.lit, RING)), F.col("side"))
    v = v.select("id", order.alias("o"), F.when(F.col("a") <= F.col("b"), F.col("pos")).otherwise(-F.col("pos")).alias("k"), "x", "y")
    w = Window.partitionBy("id").orderBy("o", "k")
    v = v.withColumn("nth", F.row_number().over(Window.partitionBy("id", "o").orderBy("k"))).where("o = 1 OR nth > 1")
    v = v.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)}).where("px IS NULL OR px <> x OR py <> y")
    return v.select("id", F.row_number().over(w).alias("pos"), "x", "y"), problems


def clip_by_bounds(regions: DataFrame, cuts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rings, notes) of ``regions`` (id, ring) cut by ``cuts`` (id, side, px, py, nx, ny), straight lines with a normal that points
    north or east, side by side in the order of CUTS: a northern bound keeps what lies south of it, and so on.

    notes: (id, side, note): cut, inside (the region lies on the kept side already) or outside (it lies on the other side
    altogether, which contradicts the contract; it is left as it is). Regions without a cut on a side pass on unchanged.
    """
    xy = "array<struct<x:double,y:double>>"
    now, notes = regions.select("id", F.col("ring").cast(xy).alias("ring")), None
    for side in CUTS:
        sign = -1.0 if side in ("北", "东") else 1.0
        line = cuts.where(F.col("side") == side).select("id", "px", "py", (F.col("nx") * sign).alias("nx"), (F.col("ny") * sign).alias("ny"))
        asked = stored(now.join(line, "id"), "asked")
        point = F.sort_array(F.collect_list(F.struct("n", "x", "y")))  # a ring's own vertices
        kept = clip_half_plane(asked, "id").groupBy("id").agg(F.transform(point, lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("new"))
        inside = F.forall("ring", lambda v: (v["x"] - F.col("px")) * F.col("nx") + (v["y"] - F.col("py")) * F.col("ny") >= 0)
        done = asked.join(kept, "id", "left").select("id", F.lit(side).alias("side"), F.when(F.col("new").isNull(), "outside").when(inside, "inside").otherwise("cut").alias("note"), F.when(F.col("new").isNotNull() & ~inside, F.col("new")).alias("new"))
        done = stored(done, "cut")
        now = stored(now.join(done.select("id", "new"), "id", "left").select("id", F.coalesce("new", "ring").alias("ring")), "ring")
        note = done.select("id", "side", "note")
        notes = note if notes is None else notes.unionByName(note)
    return now, notes
