"""Queries on scores of geometry and on the fence registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.bindings import X0, Y0, sql
from terrane.operators import graph as G
from terrane.operators import scores as Q
from terrane.operators import spatial as S
from terrane.plans import landmarks, scenarios
from terrane.plans import containment as P
from terrane.plans.landmarks import FENCE
from terrane.plans.scenarios import Case
from terrane.session import stored

#: Sampling as parameters: points of a street's border, vertices of a fence ring, points of a border by its length in micro-degrees, points of a part.
STREET_SAMPLES, FENCE_VERTICES, RECALL_STEP, SNAP_STEP, PART_POINTS = 40, 200, 500, 2_500, 200


def street_rings(spark, d):
    """(street, ring) of the streets that have units; a vertex at each corner of its outer cells."""
    n, step = B.grid(spark, d)
    x0, y0 = F.expr(f"{X0} + (street div {n // 5}) * {5 * step}"), F.expr(f"{Y0} + (street % {n // 5}) * {5 * step}")
    corner = lambda i, j: F.struct((x0 + i * step).alias("x"), (y0 + j * step).alias("y"))
    round_ = [(i, 0) for i in range(5)] + [(5, j) for j in range(5)] + [(i, 5) for i in range(5, 0, -1)] + [(0, j) for j in range(5, 0, -1)]
    return B.units(spark, d).select("street").distinct().select("street", F.array(*(corner(i, j) for i, j in round_)).alias("ring"))


def street_squares(spark, d):
    """(street, ring) of the streets that have units, by their four corners."""
    return street_rings(spark, d).select("street", F.array(*(F.get("ring", F.lit(k)) for k in (0, 5, 10, 15))).alias("ring"))


def street_coverage(spark, d):
    """Share of 40 samples of each street's border that a dealer's fences hold, from 0.15 on."""
    s = stored(Q.ring_samples(street_squares(spark, d), ["street"], STREET_SAMPLES), "samples")
    held = S.contain(s, B.fences(spark, d), ["dealer_id"]).select("street", "k", "dealer_id").distinct().groupBy("dealer_id", "street").agg(F.count("*").alias("n"))
    share = F.col("n") / STREET_SAMPLES
    return held.select("dealer_id", "street", F.round(share, 9).alias("share"), Q.coverage_class(share).alias("held")).where("held IS NOT NULL")


def rebuilt(spark, d):
    """(dealer_id, ring): the square round each dealer's centre, shifted by a tenth, as a rebuilt fence."""
    corner = lambda sx, sy: F.struct(F.expr(f"cx + ({sx}) * h + h div 10").alias("x"), F.expr(f"cy + ({sy}) * h").alias("y"))
    return B.dealers(spark, d).select("dealer_id", F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring"))


def overlap(spark, d):
    """Grid overlap of all of each dealer's components with its rebuilt fence on a grid of half a kilometre, or a tenth of the
    fence's half-width if that is less; the share of its stores that the rebuilt fence holds; and both areas."""
    a, b = B.fences(spark, d).select("dealer_id", "ring"), rebuilt(spark, d)
    steps = B.dealers(spark, d).selectExpr("dealer_id", "greatest(1, least(4892, h div 10)) AS sx", "greatest(1, least(4522, h div 10)) AS sy")
    cells = Q.grid_overlap(a, b, steps, "dealer_id")
    p = B.stores(spark, d).select("store_id", "x", "y")
    held = S.contain(p, a, ["dealer_id"]).select("dealer_id", "store_id").distinct().join(S.contain(p, b, ["dealer_id"]).select("dealer_id", "store_id", F.lit(1).alias("new")), ["dealer_id", "store_id"], "left")
    stores = held.groupBy("dealer_id").agg(F.count("*").alias("stores"), F.count("new").alias("kept"))
    area = lambda f, n: f.groupBy("dealer_id").agg(F.round(F.sum(S.ring_area_km2(F.col("ring"), X0, Y0, P.LAT)), 4).alias(n))
    j = cells.join(stores, "dealer_id", "left").join(area(a, "area"), "dealer_id").join(area(b, "rebuilt_area"), "dealer_id")
    return j.select("dealer_id", F.round(F.col("inter") / F.col("either"), 9).alias("iou"), F.round(F.col("kept") / F.col("stores"), 9).alias("containment"), "area", "rebuilt_area")


def stretches(spark, d):
    return stored(Q.segments(B.landmarks(spark, d), ["name", "seg"]), "stretches")


RADII = {"r1": 1_000.0, "r3": 3_000.0}


def border_points(spark, d, step):
    """Points in the middle of each stretch of about ``step`` micro-degrees of every fence's border."""
    return stored(Q.ring_samples(B.fences(spark, d), FENCE, F.greatest(F.lit(1), F.floor(F.col("whole") / step)), middle=True), "samples")


def recall(spark, d):
    """Share of each fence's border, sampled every 55 metres or so, with a line within 1 and 3 km."""
    s = border_points(spark, d, RECALL_STEP)
    met = Q.reach_class(s, [*FENCE, "k"], stretches(spark, d), list(RADII.values()))
    return met.groupBy(*FENCE).agg(*(F.round(F.count_if(F.col("reached") <= k) / F.count("*"), 9).alias(n) for k, n in enumerate(RADII)))


def fidelity(spark, d):
    """Share of 200 border samples of each of a dealer's components within 150 m of the dealer's contract lines (four brands)."""
    s = stored(Q.ring_samples(B.fences(spark, d), FENCE, PART_POINTS), "samples")
    met = Q.reach_class(s.join(contract_lines(spark, d), "dealer_id"), [*FENCE, "k"], stretches(spark, d), [150.0], by=("name",))
    hit = met.groupBy(*FENCE, "k").agg(F.min("reached").alias("reached"))
    return hit.groupBy("dealer_id").agg(F.count("*").alias("n"), F.count_if(F.col("reached") == 0).alias("hit")).withColumn("share", F.round(F.col("hit") / F.col("n"), 9))


def contract_lines(spark, d):
    """(dealer_id, name): the four brands of each dealer's contract."""
    return B.dealers(spark, d).select("dealer_id", F.explode(F.array(*(F.concat(F.lit("Brand#"), (1 + (F.col("dealer_id") + 6 * k) % 25).cast("string")) for k in range(4)))).alias("name"))


def correlated(spark, d):
    """Correlation over dealers of fidelity and grid overlap; null if one of them is the same everywhere."""
    j = fidelity(spark, d).select("dealer_id", "share").join(overlap(spark, d).select("dealer_id", "iou"), "dealer_id")
    return j.agg(F.count("*").alias("n"), F.covar_pop("share", "iou").alias("c"), F.var_pop("share").alias("vs"), F.var_pop("iou").alias("vi")).select("n", F.when((F.col("vs") > 1e-12) & (F.col("vi") > 1e-12), F.round(F.col("c") / F.sqrt(F.col("vs") * F.col("vi")), 8)).alias("r"))


def deviation(spark, d):
    """Upper median of the distances in metres from each vertex of a dealer's components, 200 of a part at most, to its rebuilt
    fence's border, and back."""
    a, b = B.fences(spark, d).select("dealer_id", "comp", "ring"), rebuilt(spark, d).withColumn("comp", F.lit(0))

    def one_way(src, dst):
        v = Q.thinned(src, FENCE, FENCE_VERTICES)
        e = dst.select("dealer_id", F.explode(S.edges(F.col("ring"))).alias("e")).select("dealer_id", "e.*")
        m = Q.metres_to_segment(*map(F.col, ("x", "y", "x1", "y1", "x2", "y2")))
        return v.join(e, "dealer_id").groupBy(*FENCE, "k").agg(F.min(m).alias("m")).select("dealer_id", F.round("m", 4).alias("m"))

    return Q.rank_at(one_way(a, b).unionByName(one_way(b, a)), ["dealer_id"], "m", {"median": F.floor(F.col("n") / 2) + 1})


def corridor(spark, d):
    """Per dealer, distances in km from its centre to every fifth vertex, by place, of each part of its contract lines: the 95 %
    rank plus 1.5 km, and the middle one."""
    own = contract_lines(spark, d).groupBy("dealer_id").agg(F.sort_array(F.collect_list("name")).alias("lines"))  # four names
    c = own.join(B.dealers(spark, d).select("dealer_id", "cx", "cy"), "dealer_id")
    place = F.row_number().over(Window.partitionBy("name", "seg").orderBy("pos")) - 1
    v = B.landmarks(spark, d).withColumn("place", place).where("place % 5 = 0").select("name", "x", "y")
    km = Q.distance_ranks(c, "lines", v, "name", "dealer_id", [0.95, 0.5])
    return km.select("dealer_id", F.round(F.round("p0", 6) + 1.5, 6).alias("radius"), F.round("p1", 6).alias("tau"))


def unit_roads(spark, d):
    """Roads with a stretch within 1 km of a unit's centre."""
    lines = stretches(spark, d)
    u = B.units(spark, d).select("unit_id", "x", "y").crossJoin(stored(lines.select("name").distinct(), "names"))  # 25 names at every scale
    return Q.reach_class(u, ["unit_id"], lines, [1_000.0], by=("name",)).where("reached = 0").select("unit_id", "name")


def snapped(spark, d):
    """The five nearest stretches within 3 km of each border sample, rivers ahead by a prior; samples without any stand alone."""
    s = border_points(spark, d, SNAP_STEP)
    met = stored(Q.nearest_stretches(s, [*FENCE, "k"], stretches(spark, d), ["name", "seg", "pos"], 5, RADII["r3"]).withColumn("m", F.round("m", 4)), "met")
    prior = F.when(F.substring("name", 7, 9).cast("int") % 3 == 0, 0.5).otherwise(0.0)
    found = Q.best_matches(s, met, [*FENCE, "k"], 5, 1_000.0, prior, RADII["r3"])
    return found.select(*FENCE, F.col("k").cast("int").alias("k"), F.col("rank").cast("int").alias("rank"), "name", "seg", F.round("score", 6).alias("score"))


def radii(spark, d):
    """Clip radii: from the expected area, and from the furthest vertex."""
    held = P.store_fence(spark, d).select("dealer_id", "store_id").distinct().groupBy("dealer_id").agg(F.count("*").alias("stores"))
    far = B.fence_vertices(spark, d).join(B.dealers(spark, d).select("dealer_id", "cx", "cy"), "dealer_id").groupBy("dealer_id").agg((F.sqrt(F.max(S.km2(F.col("x"), F.col("y"), F.col("cx"), F.col("cy")))) * 1.25).alias("oracle"))
    rows = Q.clip_radii(far.join(held, "dealer_id", "left").fillna(0, ["stores"]).withColumn("density", F.lit(0.5)))
    return rows.select("dealer_id", F.round("blind", 6).alias("blind"), F.round("oracle", 6).alias("oracle"))


def quality(spark, d):
    """Whether rebuilt areas are plausible; every fourth dealer counts as new."""
    area = P.dealer_area(spark, d).select("dealer_id", F.when(F.col("dealer_id") % 4 != 0, F.col("area_km2")).alias("owned_km2"))
    held = P.store_fence(spark, d).select("dealer_id", "store_id").distinct().groupBy("dealer_id").agg(F.count("*").alias("stores"))
    new = rebuilt(spark, d).select("dealer_id", S.ring_area_km2(F.col("ring"), X0, Y0, P.LAT).alias("rebuilt_km2"))
    rows = Q.rebuilt_quality(area.join(held, "dealer_id", "left").fillna(0, ["stores"]).join(new, "dealer_id").withColumn("density", F.lit(0.05)))
    return rows.select("dealer_id", F.round("estimate", 6).alias("estimate"), "ok")


def capped(spark, d):
    """Of each street of which a dealer has 15 % of the units or more, as many of its units as the dealer has, those nearest to the
    dealer's centre; whole streets from 95 % on."""
    c = Case(spark, d)
    held = c.sets.join(c.units.select("unit_id", "street"), "unit_id").groupBy("dealer_id", "street").agg(F.count("*").alias("held"))
    part = held.join(c.units.groupBy("street").agg(F.count("*").alias("all")), "street").withColumn("share", F.col("held") / F.col("all")).where("share >= 0.15")
    part = part.select("dealer_id", "street", F.when(F.col("share") > 0.95, 1.0).otherwise(F.col("share")).alias("share"))
    every = part.join(c.units.select("street", "unit_id", "x", "y"), "street").join(B.dealers(spark, d).select("dealer_id", "cx", "cy"), "dealer_id")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return Q.nearest_share(every.select("dealer_id", "street", "unit_id", "share", (dx * dx + dy * dy).alias("d")), ["dealer_id", "street"]).select("dealer_id", "street", "unit_id")


def border_streets(spark, d):
    """Streets in whose units' cells, or next to them, a sampled border vertex lies, confirmed by the street's ring holding it."""
    s = stored(Q.vertex_samples(B.fences(spark, d), FENCE, FENCE_VERTICES), "samples")
    n, step = B.grid(spark, d)
    cell = lambda c, at: F.floor((F.col(c) - at) / step)
    around = F.explode(F.array(*(F.struct((cell("x", X0) + dx).alias("i"), (cell("y", Y0) + dy).alias("j")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
    near = s.select("dealer_id", "x", "y", around.alias("c")).select("dealer_id", "x", "y", "c.*").join(B.units(spark, d).select("i", "j", "street"), ["i", "j"]).select("dealer_id", "x", "y", "street").distinct()
    sq = street_rings(spark, d).select("street", S.edges(F.col("ring")).alias("e"))
    return near.join(sq, "street").where(S.inside(F.col("e"), F.col("x"), F.col("y"))).select("dealer_id", "street").distinct()


def outlines(spark, d, c):
    """(dealer_id, x1, y1, x2, y2): the borders of each dealer's units, in micro-degrees."""
    n, step = B.grid(spark, d)
    e = G.border_edges(c.sets.join(c.units.select("unit_id", "i", "j"), "unit_id"), "dealer_id")
    return e.selectExpr("dealer_id", *[f"{at} + {v} * {step} AS {v}" for at, v in ((X0, "x1"), (Y0, "y1"), (X0, "x2"), (Y0, "y2"))])


def border_lengths(spark, d):
    """Dealers whose units' outlines run along each other for more than 200 m, and how far."""
    return Q.shared_borders(outlines(spark, d, Case(spark, d)), "dealer_id").where("metres > 200").select("a", "b", F.round("metres", 3).alias("metres"))


def tokens(spark, d):
    """(area_id, area_km2, kind, nth, token): what a fence is known by: districts with more than 2 % of their units or most of its own, streets with
    more than 10 % of their units, the labels of the four bounds of all its components, and its first six neighbours by shared border."""
    c = Case(spark, d)
    u = c.units.select("unit_id", "street", "district")
    own = stored(c.sets.join(u, "unit_id"), "own")
    total = lambda k: u.groupBy(k).agg(F.count("*").alias("total"))
    held = own.groupBy("dealer_id").agg(F.count("*").alias("held"))
    part = lambda k: own.groupBy("dealer_id", k).agg(F.count("*").alias("n")).join(total(k), k).join(held, "dealer_id")
    token = lambda kind, t, nth=None: [F.col("dealer_id"), F.lit(kind).alias("kind"), (F.lit(0) if nth is None else nth).cast("int").alias("nth"), t.alias("token")]
    rows = part("district").where("n > 0.02 * total OR n > 0.5 * held").select(*token("district", F.concat(F.lit("区"), F.col("district").cast("string"))))
    rows = rows.unionByName(part("street").where("n > 0.1 * total").select(*token("street", F.concat(F.lit("区·第"), F.col("street").cast("string"), F.lit("街道")))))
    rows = rows.unionByName(landmarks.labels(spark, d).select(*token("road", F.col("label"))))
    pairs = stored(Q.shared_borders(outlines(spark, d, c), "dealer_id").where("metres > 200").select("a", "b"), "pairs")
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nth = F.row_number().over(Window.partitionBy("a").orderBy("b"))
    first = pairs.withColumn("nth", nth).where("nth <= 6").select(F.col("a").alias("dealer_id"), F.lit("neighbour").alias("kind"), F.col("nth").cast("int").alias("nth"), F.concat(F.lit("D"), F.col("b").cast("string")).alias("token"))
    area = P.dealer_area(spark, d).select("dealer_id", F.round("area_km2", 1).alias("area_km2"))
    return stored(rows.unionByName(first).join(area, "dealer_id").select(F.col("dealer_id").alias("area_id"), "area_km2", "kind", "nth", "token").distinct(), "tokens")


def registry(spark, d):
    """One row a fence: each kind of tokens as a sorted list, and its profile in words: districts, streets, bounds, the first four
    neighbours and the area."""
    t = tokens(spark, d)
    listed = lambda kind, cut="、", most=6: F.coalesce(F.array_join(F.sort_array(F.collect_set(F.when((F.col("kind") == kind) & (F.col("nth") <= most), F.col("token")))), cut), F.lit(""))  # noqa: E731  a fence's own tokens
    kinds = [listed(k).alias(k) for k in ("district", "street", "road", "neighbour")]
    profile = F.concat(listed("district", "/"), F.lit(" "), listed("street"), F.lit(" 边界:"), listed("road", "/"), F.lit(" 邻:"), listed("neighbour", "/", 4), F.lit(" 面积"), F.round("area_km2", 0).cast("long").cast("string"), F.lit("km²"))
    return t.groupBy("area_id", "area_km2").agg(*kinds, profile.alias("profile"))


def searched(spark, d):
    """Texts that name a street, a district, a neighbour and an area, one for each dealer."""
    texts = B.dealers(spark, d).selectExpr("dealer_id AS query_id", "concat('找第', dealer_id % 30, '附近、区', dealer_id % 5, '，挨着D', dealer_id % 7, '，约', 50 + dealer_id % 90, '平方公里') AS text")
    return Q.search(texts, tokens(spark, d).drop("nth")).select("query_id", F.col("rank").cast("int").alias("rank"), "area_id", "score")


QUERIES = {
    "a18_street_coverage": street_coverage,
    "a20_grid_overlap": overlap,
    "a27_boundary_recall": recall,
    "a28_boundary_deviation": deviation,
    "a29_fidelity": fidelity,
    "a33_correlation": correlated,
    "a36_corridor": corridor,
    "j12_unit_roads": unit_roads,
    "j13_shared_border": border_lengths,
    "j18_candidate_snap": snapped,
    "p26_clip_radius": radii,
    "r14_rebuilt_quality": quality,
    "w4_nearest_share": capped,
    "u7_border_streets": border_streets,
    "a30_fence_registry": registry,
    "t3_fence_search": searched,
}


def _inside(points: str, edge: str, keys: str, on: str) -> str:
    """Distinct ``keys`` of ``points`` p and ``edge`` e where the ring holds the point."""
    bare = keys.replace("p.", "").replace("e.", "")
    return f"SELECT DISTINCT {bare} FROM (SELECT {keys}, count(*) AS c FROM {points} p JOIN {edge} e ON {on} (e.y1 > p.y) <> (e.y2 > p.y) AND CASE WHEN e.y2 > e.y1 THEN (p.x - e.x1) * (e.y2 - e.y1) < (p.y - e.y1) * (e.x2 - e.x1) ELSE (p.x - e.x1) * (e.y2 - e.y1) > (p.y - e.y1) * (e.x2 - e.x1) END GROUP BY {keys}, e.comp) WHERE c % 2 = 1"


def _samples(edge: str, keys: str, n: str, shift: float = 0.0) -> str:
    along = f"((k + {shift}::DOUBLE) * (whole / n))"
    return f"SELECT {keys}, k, x1 + ({along} - f) / len * (x2 - x1) AS x, y1 + ({along} - f) / len * (y2 - y1) AS y FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, t - len AS f, CAST({n} AS BIGINT) AS n FROM (SELECT *, sum(len) OVER (PARTITION BY {keys} ORDER BY pos) AS t, sum(len) OVER (PARTITION BY {keys}) AS whole FROM (SELECT *, sqrt(CAST((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1) AS DOUBLE)) AS len FROM {edge})))) WHERE len > 0 AND {along} >= f AND {along} < t"


def _metres(p: str, e: str) -> str:
    dx, dy, px, py = f"(({e}.x2 - {e}.x1) * 0.1022::DOUBLE)", f"(({e}.y2 - {e}.y1) * 0.110574::DOUBLE)", f"(({p}.x - {e}.x1) * 0.1022::DOUBLE)", f"(({p}.y - {e}.y1) * 0.110574::DOUBLE)"
    t = f"CASE WHEN {dx} * {dx} + {dy} * {dy} > 0 THEN greatest(0, least(1, ({px} * {dx} + {py} * {dy}) / ({dx} * {dx} + {dy} * {dy}))) ELSE 0 END"
    return f"sqrt(pow({px} - {t} * {dx}, 2) + pow({py} - {t} * {dy}, 2))"


_SQ = "SELECT street, 0 AS comp, pos, x1, y1, x2, y2 FROM (SELECT DISTINCT street, 1000000 // n AS step, n FROM unit, grid), LATERAL (SELECT 113000000 + (street // (n // 5)) * 5 * step AS a, 22500000 + (street % (n // 5)) * 5 * step AS b, 5 * step AS w), LATERAL (VALUES (0, a, b, a + w, b), (1, a + w, b, a + w, b + w), (2, a + w, b + w, a, b + w), (3, a, b + w, a, b)) v(pos, x1, y1, x2, y2)"
_NEW = "SELECT dealer_id, 9 AS comp, pos, x1, y1, x2, y2 FROM dealer, LATERAL (SELECT cx - h + h // 10 AS a, cx + h + h // 10 AS b, cy - h AS c, cy + h AS e), LATERAL (VALUES (0, a, c, b, c), (1, b, c, b, e), (2, b, e, a, e), (3, a, e, a, c)) v(pos, x1, y1, x2, y2)"
_LINES = "SELECT name, seg, pos, x AS x1, y AS y1, x2, y2 FROM (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM landmark WINDOW w AS (PARTITION BY name, seg ORDER BY pos)) WHERE x2 IS NOT NULL"
_FS = _samples("fence_edge", "dealer_id, comp", f"greatest(1, floor(whole / {RECALL_STEP}))", 0.5)
_FSNAP = _samples("fence_edge", "dealer_id, comp", f"greatest(1, floor(whole / {SNAP_STEP}))", 0.5)
_NEAREST = f"SELECT dealer_id, comp, k, min({_metres('p', 'l')}) AS m FROM fs p, line l GROUP BY 1, 2, 3"
_BOX = "SELECT dealer_id, min(least(x1, x2)) AS x0, max(greatest(x1, x2)) AS x1, min(least(y1, y2)) AS y0, max(greatest(y1, y2)) AS y1, greatest(1, least(4892, any_value(h) // 10)) AS sx, greatest(1, least(4522, any_value(h) // 10)) AS sy FROM (SELECT * FROM fence_edge UNION ALL SELECT * FROM new) JOIN dealer USING (dealer_id) GROUP BY 1"
_GRID = "SELECT dealer_id, x, y FROM (SELECT dealer_id, x, y0, y1, sy, unnest(range(y0, y1 + 1, sy)) AS y FROM (SELECT dealer_id, y0, y1, sy, unnest(range(x0, x1 + 1, sx)) AS x FROM box)) c WHERE EXISTS (SELECT 1 FROM rbox b WHERE b.dealer_id = c.dealer_id AND c.x BETWEEN b.x0 AND b.x1 AND c.y BETWEEN b.y0 AND b.y1)"
_RBOX = "SELECT dealer_id, comp, min(x1) AS x0, max(x1) AS x1, min(y1) AS y0, max(y1) AS y1 FROM (SELECT dealer_id, comp, x1, y1 FROM fence_edge UNION ALL SELECT dealer_id, comp, x1, y1 FROM new) GROUP BY 1, 2"
_BOTH = "SELECT dealer_id, round(count(*) FILTER (WHERE o AND w) / count(*), 9) AS iou FROM (SELECT dealer_id, x, y, bool_or(o) AS o, bool_or(NOT o) AS w FROM (SELECT *, true AS o FROM ga UNION ALL SELECT *, false FROM gb) GROUP BY 1, 2, 3) GROUP BY 1"
_AREA = "SELECT dealer_id, round(sum(area), 4) AS area FROM (SELECT dealer_id, comp, abs(sum((x1 - 113000000) * (y2 - 22500000) - (x2 - 113000000) * (y1 - 22500000))) / 2.0 / 1e12 * 111.32 * 111.32 * cos(radians(22.5)) AS area FROM {} GROUP BY 1, 2) GROUP BY 1"
_SAME = "p.dealer_id = e.dealer_id AND "
_IOU = {"one": "SELECT * FROM fence_edge", "new": _NEW, "box": _BOX, "rbox": _RBOX, "cells": _GRID, "ga": _inside("cells", "one", "p.dealer_id, p.x, p.y", _SAME), "gb": _inside("cells", "new", "p.dealer_id, p.x, p.y", _SAME), "both_": _BOTH, "sa": _inside("store", "one", "e.dealer_id, p.store_id", ""), "sb": _inside("store", "new", "e.dealer_id, p.store_id", ""), "aa": _AREA.format("one"), "ab": _AREA.format("new")}
_IOU_SQL = "SELECT dealer_id, iou, containment, aa.area AS area, ab.area AS rebuilt_area FROM both_ LEFT JOIN (SELECT sa.dealer_id, round(count(sb.store_id) / count(*), 9) AS containment FROM sa LEFT JOIN sb USING (dealer_id, store_id) GROUP BY 1) USING (dealer_id) JOIN aa USING (dealer_id) JOIN ab USING (dealer_id)"
_CONTRACT = "SELECT dealer_id, 'Brand#' || (1 + (dealer_id + 6 * k) % 25) AS name FROM dealer, range(4) r(k)"
_FID = {"os": _samples("fence_edge", "dealer_id, comp", str(PART_POINTS)), "line": _LINES, "contract": _CONTRACT, "fid": f"SELECT dealer_id, count(*) AS n, count(*) FILTER (WHERE m <= 150) AS hit, round(count(*) FILTER (WHERE m <= 150) / count(*), 9) AS share FROM (SELECT p.dealer_id, p.comp, p.k, min({_metres('p', 'l')}) AS m FROM os p LEFT JOIN contract c ON c.dealer_id = p.dealer_id LEFT JOIN line l ON l.name = c.name GROUP BY 1, 2, 3) GROUP BY 1"}
_DEV = f"SELECT dealer_id, round(m, 4) AS m FROM (SELECT p.dealer_id, p.comp, p.pos, min({_metres('p', 'e')}) AS m FROM (SELECT dealer_id, comp, pos, x1 AS x, y1 AS y FROM fence_edge) p JOIN new e ON e.dealer_id = p.dealer_id GROUP BY 1, 2, 3 UNION ALL SELECT p.dealer_id, p.comp, p.pos, min({_metres('p', 'e')}) FROM (SELECT dealer_id, comp, pos, x1 AS x, y1 AS y FROM new) p JOIN fence_edge e ON e.dealer_id = p.dealer_id GROUP BY 1, 2, 3)"
_OWNED = "SELECT a.dealer_id, CASE WHEN a.dealer_id % 4 <> 0 THEN a.area_km2 END AS owned, coalesce(stores, 0) AS stores, a.area_km2 FROM (SELECT dealer_id, sum(area_km2) AS area_km2 FROM area GROUP BY 1) a LEFT JOIN (SELECT dealer_id, count(DISTINCT store_id) AS stores FROM held GROUP BY 1) USING (dealer_id)"
_PART = "SELECT s.dealer_id, u.{k}, count(*) AS n, (SELECT count(*) FROM unit o WHERE o.{k} = u.{k}) AS total, (SELECT count(*) FROM sets o WHERE o.dealer_id = s.dealer_id) AS own FROM sets s JOIN unit u USING (unit_id) GROUP BY s.dealer_id, u.{k}"
_SIDES = "SELECT dealer_id, bi, bj FROM (SELECT dealer_id, unnest([2 * i + 1, 2 * i - 1, 2 * i, 2 * i]) AS bi, unnest([2 * j, 2 * j, 2 * j + 1, 2 * j - 1]) AS bj FROM sets JOIN unit USING (unit_id)) GROUP BY 1, 2, 3 HAVING count(*) = 1"
_BORDERS = "SELECT p.dealer_id AS a, q.dealer_id AS b, round(sum(CASE WHEN p.bi % 2 = 0 THEN step * 0.1022::DOUBLE ELSE step * 0.110574::DOUBLE END), 3) AS metres FROM sides p JOIN sides q ON p.bi = q.bi AND p.bj = q.bj AND p.dealer_id < q.dealer_id, grid GROUP BY 1, 2 HAVING metres > 200"
_TOK = "SELECT DISTINCT dealer_id AS area_id, area_km2, kind, nth, token FROM (SELECT dealer_id, 'district' AS kind, 0 AS nth, '区' || district AS token FROM dpart WHERE n > 0.02 * total OR n > 0.5 * own UNION ALL SELECT dealer_id, 'street', 0, '区·第' || street || '街道' FROM spart WHERE n > 0.1 * total UNION ALL SELECT dealer_id, 'road', 0, label FROM lab UNION ALL SELECT a, 'neighbour', r, 'D' || b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM (SELECT a, b FROM pair UNION SELECT b, a FROM pair)) WHERE r <= 6) JOIN (SELECT dealer_id, round(sum(area_km2), 1) AS area_km2 FROM area GROUP BY 1) USING (dealer_id)"
_REG = landmarks._BOUNDS | {"sets": scenarios._SETS, "dpart": _PART.format(k="district"), "spart": _PART.format(k="street"), "sides": _SIDES, "pair": _BORDERS, "tok": _TOK}
_LISTED = "coalesce(string_agg(DISTINCT token, '{}' ORDER BY token) FILTER (WHERE kind = '{}' AND nth <= {}), '')"
_LIST = ", ".join(f"{_LISTED.format('、', k, 6)} AS {k}" for k in ("district", "street", "road", "neighbour"))
_PROFILE = f"{_LISTED.format('/', 'district', 6)} || ' ' || {_LISTED.format('、', 'street', 6)} || ' 边界:' || {_LISTED.format('/', 'road', 6)} || ' 邻:' || {_LISTED.format('/', 'neighbour', 4)} || ' 面积' || CAST(round(area_km2, 0) AS BIGINT) || 'km²' AS profile"
_TEXT = "SELECT dealer_id AS query_id, '找第' || dealer_id % 30 || '附近、区' || dealer_id % 5 || '，挨着D' || dealer_id % 7 || '，约' || (50 + dealer_id % 90) || '平方公里' AS text, 50 + dealer_id % 90 AS km2 FROM dealer"
SQL = {
    "a18_street_coverage": sql(f"SELECT dealer_id, street, round(n / {STREET_SAMPLES}, 9) AS share, CASE WHEN n / {STREET_SAMPLES} >= 0.85 THEN 'full' ELSE 'part' END AS held FROM (SELECT dealer_id, street, count(*) AS n FROM inn GROUP BY 1, 2) WHERE n / {STREET_SAMPLES} >= 0.15", sq=_SQ, ss=_samples("sq", "street", str(STREET_SAMPLES)), inn=_inside("ss", "fence_edge", "e.dealer_id, p.street, p.k", "")),
    "a20_grid_overlap": sql(_IOU_SQL, **_IOU),
    "a27_boundary_recall": sql("SELECT dealer_id, comp, round(count(*) FILTER (WHERE m <= 1000) / count(*), 9) AS r1, round(count(*) FILTER (WHERE m <= 3000) / count(*), 9) AS r3 FROM near_line GROUP BY 1, 2", fs=_FS, line=_LINES, near_line=_NEAREST),
    "a28_boundary_deviation": sql("SELECT dealer_id, max(m) FILTER (WHERE r = n // 2 + 1) AS median FROM (SELECT *, row_number() OVER (PARTITION BY dealer_id ORDER BY m) AS r, count(*) OVER (PARTITION BY dealer_id) AS n FROM dev) GROUP BY 1", new=_NEW, dev=_DEV),
    "a29_fidelity": sql("SELECT * FROM fid", **_FID),
    "a33_correlation": sql(f"SELECT count(*) AS n, CASE WHEN var_pop(share) > 1e-12 AND var_pop(iou) > 1e-12 THEN round(covar_pop(share, iou) / sqrt(var_pop(share) * var_pop(iou)), 8) END AS r FROM fid JOIN ({_IOU_SQL}) USING (dealer_id)", **_FID, **_IOU),
    "a36_corridor": sql("SELECT dealer_id, round(max(km) FILTER (WHERE r = least(floor(n * 0.95) + 1, n)) + 1.5, 6) AS radius, max(km) FILTER (WHERE r = least(floor(n * 0.5) + 1, n)) AS tau FROM (SELECT *, row_number() OVER (PARTITION BY dealer_id ORDER BY km) AS r, count(*) OVER (PARTITION BY dealer_id) AS n FROM (SELECT dealer_id, round(sqrt(pow((x - cx) / 1e6 * 102.2, 2) + pow((y - cy) / 1e6 * 110.574, 2)), 6) AS km FROM dealer JOIN contract USING (dealer_id) JOIN (SELECT *, row_number() OVER (PARTITION BY name, seg ORDER BY pos) - 1 AS place FROM landmark) l ON l.name = contract.name AND place % 5 = 0)) GROUP BY 1", contract=_CONTRACT),
    "j12_unit_roads": sql(f"SELECT DISTINCT unit_id, name FROM unit p, line l WHERE {_metres('p', 'l')} <= 1000", line=_LINES),
    "j13_shared_border": sql("SELECT * FROM pair", sets=scenarios._SETS, sides=_SIDES, pair=_BORDERS),
    "j18_candidate_snap": sql("SELECT dealer_id, comp, CAST(k AS INTEGER) AS k, CAST(rank AS INTEGER) AS rank, name, seg, round(-pow(m / 1000.0, 2) / 2 + CASE WHEN CAST(substr(name, 7) AS INTEGER) % 3 = 0 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END, 6) + 0.0::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY dealer_id, comp, k ORDER BY m, name, pos) AS rank FROM met) WHERE rank <= 5 UNION ALL SELECT dealer_id, comp, CAST(k AS INTEGER), 1, NULL, NULL, -7.5::DOUBLE FROM fs p WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.dealer_id = p.dealer_id AND m.comp = p.comp AND m.k = p.k)", fs=_FSNAP, line=_LINES, met="SELECT * FROM (SELECT p.dealer_id, p.comp, p.k, l.name, l.seg, l.pos, round(" + _metres("p", "l") + ", 4) AS m FROM fs p, line l) WHERE m <= 3000"),
    "p26_clip_radius": sql("SELECT dealer_id, round(sqrt(greatest(2.0::DOUBLE, stores / 0.5::DOUBLE) / pi()) * 1.6::DOUBLE, 6) AS blind, round(oracle, 6) AS oracle FROM owned JOIN (SELECT dealer_id, sqrt(max(pow((x - cx) / 1e6 * 102.2, 2) + pow((y - cy) / 1e6 * 110.574, 2))) * 1.25::DOUBLE AS oracle FROM fence_vertex JOIN dealer USING (dealer_id) GROUP BY 1) USING (dealer_id)", owned=_OWNED),
    "r14_rebuilt_quality": sql("SELECT dealer_id, round(estimate, 6) AS estimate, km2 BETWEEN 0.3 * estimate AND 3 * estimate AS ok FROM (SELECT dealer_id, coalesce(owned, greatest(2.0::DOUBLE, stores / 0.05::DOUBLE)) AS estimate FROM owned) JOIN (SELECT dealer_id, abs(sum((x1 - 113000000) * (y2 - 22500000) - (x2 - 113000000) * (y1 - 22500000))) / 2.0 / 1e12 * 111.32 * 111.32 * cos(radians(22.5)) AS km2 FROM new GROUP BY 1) USING (dealer_id)", owned=_OWNED, new=_NEW),
    "w4_nearest_share": sql("SELECT dealer_id, street, unit_id FROM (SELECT dealer_id, street, unit_id, share, row_number() OVER (PARTITION BY dealer_id, street ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), unit_id) AS r, count(*) OVER (PARTITION BY dealer_id, street) AS n FROM (SELECT dealer_id, street, CASE WHEN n / total > 0.95 THEN 1.0 ELSE n / total END AS share FROM spart WHERE n / total >= 0.15) JOIN unit USING (street) JOIN dealer USING (dealer_id)) WHERE r <= greatest(1, round_even(n * share, 0))", sets=scenarios._SETS, spart=_PART.format(k="street")),
    "u7_border_streets": sql("SELECT DISTINCT p.dealer_id, u.street FROM (SELECT dealer_id, x, y FROM fence_vertex) p, grid JOIN unit u ON abs(u.i - floor((p.x - 113000000) / step)) <= 1 AND abs(u.j - floor((p.y - 22500000) / step)) <= 1 WHERE u.street // (n // 5) = floor((p.x - 113000000) / (5 * step)) AND u.street % (n // 5) = floor((p.y - 22500000) / (5 * step))"),
    "a30_fence_registry": sql(f"SELECT area_id, area_km2, {_LIST}, {_PROFILE} FROM tok GROUP BY 1, 2", **_REG),
    "t3_fence_search": sql("SELECT query_id, rank, area_id, score FROM (SELECT query_id, area_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, area_id) AS INTEGER) AS rank FROM (SELECT query_id, area_id, CAST(sum(w) AS BIGINT) AS score FROM (SELECT query_id, area_id, CASE kind WHEN 'road' THEN 3 WHEN 'street' THEN 3 WHEN 'neighbour' THEN 2 ELSE 1 END AS w FROM texts JOIN (SELECT *, CASE WHEN kind = 'street' THEN replace(replace(split_part(token, '·', -1), '街道', ''), '镇', '') ELSE token END AS core FROM tok) ON core <> '' AND contains(text, core) UNION ALL SELECT query_id, area_id, 1 FROM texts JOIN (SELECT DISTINCT area_id, area_km2 FROM tok) ON area_km2 BETWEEN 0.6 * km2 AND 1.6 * km2) GROUP BY 1, 2)) WHERE rank <= 8", **_REG, texts=_TEXT),
}
