"""Queries on fences rebuilt from contract lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.bindings import sql
from terrane.operators import rebuild as R
from terrane.operators import spatial as S
from terrane.operators.scenarios import heads
from terrane.session import stored


def lines(spark, d):
    """(name, pos, x, y): a line for each brand, its vertices numbered in order."""
    return B.landmarks(spark, d).select("name", "pos", "x", "y")


def contracts(spark, d):
    """(id, side, name): four brands for each dealer; every ninth lacks a side, every thirteenth two."""
    side = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("side")) for k, s in enumerate(R.RING))))
    c = B.dealers(spark, d).select("dealer_id", side.alias("s")).where("NOT (dealer_id % 9 = 4 AND s.k = 1) AND NOT (dealer_id % 13 = 5 AND s.k >= 2)")
    return c.select(F.col("dealer_id").alias("id"), "s.side", F.concat(F.lit("Brand#"), (1 + (F.col("dealer_id") * 3 + F.col("s.k") * 7) % 25).cast("string")).alias("name"))


def from_bounds(spark, d):
    """Each contract's ring: vertices, twice its signed area and the sums of its coordinates; or why there is none."""
    c = contracts(spark, d)
    said = stored(c.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("side", "name"))).alias("said")), "contracts")  # four sides at most
    same = stored(said.join(said.groupBy("said").agg(F.min("id").alias("first")), "said").select("id", "first"), "same")
    rings, problems = R.from_bounds(c.join(same.where("id = first").select("id"), "id"), lines(spark, d))  # contracts of the same words have the same ring
    rings = stored(rings, "rings")
    n = rings.groupBy("id").agg(F.count("*").alias("n"))
    following = rings.select("id", (F.col("pos") - 1).alias("pos"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    first = heads(rings.select("id", "pos", "x", "y"), "id", "pos", 1).select("id", "pos").join(rings, ["id", "pos"]).join(n, "id").select("id", F.col("n").alias("pos"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    e = rings.join(following.where("pos > 0").unionByName(first), ["id", "pos"])
    out = e.groupBy("id").agg(F.count("*").alias("vertices"), F.sum((F.col("x") - B.X0) * (F.col("y2") - B.Y0) - (F.col("x2") - B.X0) * (F.col("y") - B.Y0)).alias("doubled"))
    out = out.select("id", "vertices", "doubled", F.lit(None).cast("string").alias("problem")).unionByName(problems.select("id", F.lit(None).cast("long").alias("vertices"), F.lit(None).cast("long").alias("doubled"), "problem"))
    return same.join(out.withColumnRenamed("id", "first"), "first").select("id", "vertices", "doubled", "problem")


def clipped(spark, d):
    """The box of each component (id: dealer * 10 + component) cut by the fitted lines of its dealer's contract, moved to pass near the dealer:
    notes of the four cuts, vertices and area left."""
    box = S.with_box(B.fences(spark, d)).withColumn("id", F.expr("dealer_id * 10 + comp"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    regions = box.select("id", F.array(corner("bx0", "by0"), corner("bx1", "by0"), corner("bx1", "by1"), corner("bx0", "by1")).alias("ring"))
    fit = S.fit_line(lines(spark, d), ["name"]).select("name", "nx", "ny")
    shift = "CASE side WHEN '北' THEN 1 WHEN '东' THEN 1 ELSE -1 END * (id % 7 - 2) * h div 4"
    at = contracts(spark, d).join(B.dealers(spark, d).select(F.col("dealer_id").alias("id"), "cx", "cy", "h"), "id").join(fit, "name")
    at = at.withColumnRenamed("id", "dealer_id").join(box.select("dealer_id", "comp"), "dealer_id").withColumn("own", F.expr("dealer_id * 10 + comp"))
    shift = shift.replace("id %", "dealer_id %")
    cuts = at.selectExpr("own AS id", "side", f"cx + {shift} AS px", f"cy + {shift} AS py", "nx", "ny")
    rings, notes = R.clip_by_bounds(regions, cuts)
    said = notes.groupBy("id").agg(*(F.max(F.when(F.col("side") == s, F.col("note"))).alias(n) for s, n in zip(R.CUTS, ("north", "south", "east", "west"), strict=True)))
    twice = F.aggregate(S.edges(F.col("ring")), F.lit(0.0), lambda acc, e: acc + (e["x1"] - B.X0) * (e["y2"] - B.Y0) - (e["x2"] - B.X0) * (e["y1"] - B.Y0))
    return rings.join(said, "id", "left").select("id", F.size("ring").alias("vertices"), F.round(F.abs(twice) / 2e6, 2).alias("area"), "north", "south", "east", "west")


QUERIES = {"g7_fence_from_bounds": from_bounds, "g8_side_clip": clipped}
_CON = "SELECT dealer_id AS id, side, 'Brand#' || (1 + (dealer_id * 3 + k * 7) % 25) AS name, k FROM dealer, (VALUES (0, '西'), (1, '南'), (2, '东'), (3, '北')) s(k, side) WHERE NOT (dealer_id % 9 = 4 AND k = 1) AND NOT (dealer_id % 13 = 5 AND k >= 2)"
_WHOLE = "SELECT * FROM con JOIN (SELECT id FROM con GROUP BY 1 HAVING count(*) = 4) USING (id)"
_PAIRS = "SELECT a.id, a.side, b.side AS next, a.name AS one, b.name AS two FROM whole a JOIN whole b ON b.id = a.id AND b.k = (a.k + 1) % 4"
_CORNER = "SELECT one, two, (arg_min(v.x, (d, v.pos, w.pos)) + arg_min(w.x, (d, v.pos, w.pos))) / 2 AS x, (arg_min(v.y, (d, v.pos, w.pos)) + arg_min(w.y, (d, v.pos, w.pos))) / 2 AS y FROM (SELECT DISTINCT one, two FROM pairs) p JOIN landmark v ON v.name = one JOIN landmark w ON w.name = two, LATERAL (SELECT (v.x - w.x) * (v.x - w.x) + (v.y - w.y) * (v.y - w.y) AS d) GROUP BY 1, 2"
_ENDS = "SELECT id, side, one AS name, true AS last, x, y FROM pairs JOIN corner USING (one, two) UNION ALL SELECT id, next, two, false, x, y FROM pairs JOIN corner USING (one, two)"
_SITE = "SELECT e.id, e.side, e.name, e.last, arg_min(v.pos, ((e.x - v.x) * (e.x - v.x) + (e.y - v.y) * (e.y - v.y), v.pos)) AS site FROM ends e JOIN landmark v ON v.name = e.name GROUP BY ALL"
_SPAN = "SELECT id, side, name, max(site) FILTER (WHERE NOT last) AS a, max(site) FILTER (WHERE last) AS b FROM site GROUP BY 1, 2, 3"
_V = "SELECT id, o, k, x, y FROM (SELECT *, row_number() OVER (PARTITION BY id, o ORDER BY k) AS nth FROM (SELECT s.id, CASE side WHEN '西' THEN 1 WHEN '南' THEN 2 WHEN '东' THEN 3 ELSE 4 END AS o, CASE WHEN a <= b THEN v.pos ELSE -v.pos END AS k, v.x, v.y FROM span s JOIN landmark v ON v.name = s.name AND v.pos BETWEEN least(a, b) AND greatest(a, b))) WHERE o = 1 OR nth > 1"
_RING = "SELECT id, x, y, row_number() OVER (PARTITION BY id ORDER BY o, k) AS pos FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v WINDOW w AS (PARTITION BY id ORDER BY o, k)) WHERE px IS NULL OR px <> x OR py <> y"
_AREA = "SELECT id, count(*) AS vertices, CAST(sum((x - 113000000) * (y2 - 22500000) - (x2 - 113000000) * (y - 22500000)) AS BIGINT) AS doubled, NULL AS problem FROM (SELECT id, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM ring WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1"
_FIT = "SELECT name, CASE WHEN by_x THEN -slope ELSE 1 END / sqrt(1 + slope * slope) AS nx, CASE WHEN by_x THEN 1 ELSE -slope END / sqrt(1 + slope * slope) AS ny FROM (SELECT name, var_pop(x) >= var_pop(y) AS by_x, covar_pop(x, y) / greatest(var_pop(x), var_pop(y)) AS slope FROM landmark GROUP BY 1)"
_SHIFT = "CASE side WHEN '北' THEN 1 WHEN '东' THEN 1 ELSE -1 END * (c.id % 7 - 2) * h"
_LINE = f"SELECT c.id * 10 + comp AS id, side, cx + CAST(trunc({_SHIFT} / 4) AS BIGINT) AS px, cy + CAST(trunc({_SHIFT} / 4) AS BIGINT) AS py, CASE WHEN side IN ('北', '东') THEN -nx ELSE nx END AS nx, CASE WHEN side IN ('北', '东') THEN -ny ELSE ny END AS ny FROM con c JOIN dealer ON dealer.dealer_id = c.id JOIN (SELECT DISTINCT dealer_id, comp FROM fence_vertex) f ON f.dealer_id = c.id JOIN fit USING (name)"
_BOX = "SELECT dealer_id * 10 + comp AS id, unnest([0, 1, 2, 3]) AS pos, CAST(unnest([x0, x1, x1, x0]) AS DOUBLE) AS x, CAST(unnest([y0, y0, y1, y1]) AS DOUBLE) AS y FROM (SELECT dealer_id, comp, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM fence_vertex GROUP BY 1, 2)"


def _cut(k: int, side: str) -> dict[str, str]:
    """Views that cut ring k into ring k + 1 by the line on one side."""
    edge = f"SELECT r.id, r.pos, r.x, r.y, x2, y2, px IS NOT NULL AS asked, (r.x - px) * nx + (r.y - py) * ny AS a, (x2 - px) * nx + (y2 - py) * ny AS b FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM r{k} WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) r LEFT JOIN ln l ON l.id = r.id AND l.side = '{side}'"
    note = f"SELECT id, CASE WHEN NOT bool_and(asked) THEN NULL WHEN count(*) FILTER (WHERE a >= 0 OR b >= 0) = 0 THEN 'outside' WHEN bool_and(a >= 0) THEN 'inside' ELSE 'cut' END AS note FROM e{k} GROUP BY 1"
    ring = f"SELECT id, row_number() OVER (PARTITION BY id ORDER BY pos, q) AS pos, x, y FROM (SELECT e.id, pos, 0 AS q, x + a / (a - b) * (x2 - x) AS x, y + a / (a - b) * (y2 - y) AS y FROM e{k} e JOIN n{k} USING (id) WHERE note = 'cut' AND (a >= 0) <> (b >= 0) UNION ALL SELECT e.id, pos, 1, x2, y2 FROM e{k} e JOIN n{k} USING (id) WHERE note = 'cut' AND b >= 0 UNION ALL SELECT e.id, pos, 0, x, y FROM e{k} e JOIN n{k} USING (id) WHERE note IS DISTINCT FROM 'cut')"
    return {f"e{k}": edge, f"n{k}": note, f"r{k + 1}": ring}


_CLIP = {"con": _CON, "fit": _FIT, "ln": _LINE, "r0": _BOX} | _cut(0, "北") | _cut(1, "南") | _cut(2, "东") | _cut(3, "西")
SQL = {
    "g7_fence_from_bounds": sql("SELECT id, vertices, doubled, problem FROM area_ UNION ALL SELECT id, NULL, NULL, CASE WHEN count(*) < 3 THEN 'too_few_lines' ELSE 'side_missing' END FROM con GROUP BY 1 HAVING count(*) < 4", con=_CON, whole=_WHOLE, pairs=_PAIRS, corner=_CORNER, ends=_ENDS, site=_SITE, span=_SPAN, v=_V, ring=_RING, area_=_AREA),
    "g8_side_clip": sql("SELECT id, CAST(count(*) AS INTEGER) AS vertices, round(abs(sum((x - 113000000) * (y2 - 22500000) - (x2 - 113000000) * (y - 22500000))) / 2e6, 2) AS area, any_value(n0.note) AS north, any_value(n1.note) AS south, any_value(n2.note) AS east, any_value(n3.note) AS west FROM (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM r4 WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) JOIN n0 USING (id) JOIN n1 USING (id) JOIN n2 USING (id) JOIN n3 USING (id) GROUP BY 1", **_CLIP),
}
