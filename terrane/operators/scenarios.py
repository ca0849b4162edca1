"""What-if moves: unit sets, area selectors, proposals and their effect on stores.

A table of proposals is handled as a whole; each has proposal_id, src, dst and selector. Territories are sets of units
(unit_id, dealer_id), so a union of geometries is a union of sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators.classify import kind
from terrane.session import stored

# Words for a whole area, for its halves, and selectors that only stores can answer.
WHOLE = ["全部", "整体", "所有", "", "不做了", "退出", "整个区域", "整个"]
HALVES = {
    "东": "east", "南": "south", "西": "west", "北": "north",
    "东边": "east", "南边": "south", "西边": "west", "北边": "north",
    "东部": "east", "南部": "south", "西部": "west", "北部": "north",
    "东侧": "east", "南侧": "south", "西侧": "west", "北侧": "north",
    "东半区": "east", "南半区": "south", "西半区": "west", "北半区": "north",
}
NOT_AREAS = ["OOF", "跨界", "跨界供货", "非围栏供货", "错位", "错位片区"]


def half(selector: Column) -> Column:
    """east, west, north or south if the selector names a half, else null."""
    return F.element_at(F.create_map(*(F.lit(v) for kv in HALVES.items() for v in kv)), selector)


def select_units(proposals: DataFrame, sets: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(picked, verdicts). picked: (proposal_id, unit_id, src, dst). verdicts: (proposal_id, n, reason).

    ``units``: (unit_id, x, y, street, district), the latter two as text. The first that applies: same dealer (rejected), whole
    area, half on its side of the mean of the area's units (ties go east and north), street, district (also by its name
    without 区), not an area (rejected).
    A half, street or district without a unit is rejected as unknown.
    """
    asked = proposals.withColumns({"selector": F.trim(F.coalesce("selector", F.lit("全部")))}).withColumn("half", half(F.col("selector")))
    own = asked.join(sets.select(F.col("dealer_id").alias("src"), "unit_id"), "src").join(units, "unit_id")
    middle = own.groupBy("proposal_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))  # one row per proposal
    own = own.join(middle, "proposal_id")
    on_side = F.when(F.col("half") == "east", F.col("x") >= F.col("mx")).when(F.col("half") == "west", F.col("x") < F.col("mx")).when(F.col("half") == "north", F.col("y") >= F.col("my")).when(F.col("half") == "south", F.col("y") < F.col("my"))
    tier = F.when(F.col("src") == F.col("dst"), None).when(F.col("selector").isin(WHOLE), 1).when(F.col("half").isNotNull(), F.when(on_side, 2)).when(F.col("street") == F.col("selector"), 3).when((F.col("district") == F.col("selector")) | (F.col("district") == F.replace("selector", F.lit("区"), F.lit(""))), 4)
    hit = stored(own.withColumn("tier", tier).where("tier IS NOT NULL").select("proposal_id", "unit_id", "src", "dst", "tier"), "hit")  # read several times
    first = hit.groupBy("proposal_id").agg(F.min("tier").alias("tier"))
    picked = hit.join(first.select("proposal_id", "tier"), ["proposal_id", "tier"])
    per = picked.groupBy("proposal_id").agg(F.count("*").alias("n"), F.first("tier").alias("tier"))
    named = F.element_at(F.array(*map(F.lit, ["whole", "half", "street", "district"])), F.col("tier"))
    reason = F.when(F.col("src") == F.col("dst"), "same_dealer").when(F.col("tier").isNotNull(), named).when(F.col("selector").isin(NOT_AREAS), "not_an_area").otherwise("unknown")
    verdicts = asked.join(per, "proposal_id", "left").select("proposal_id", F.coalesce("n", F.lit(0)).alias("n"), reason.alias("reason"))
    return picked.select("proposal_id", "unit_id", "src", "dst"), verdicts


def transfer_units(sets: DataFrame, picked: DataFrame) -> DataFrame:
    """(dealer_id, unit_id): sets after all moves at once; a unit goes from src and is in dst once."""
    gone = picked.select(F.col("src").alias("dealer_id"), "unit_id")
    new = picked.select(F.col("dst").alias("dealer_id"), "unit_id")
    return sets.select("dealer_id", "unit_id").join(gone, ["dealer_id", "unit_id"], "left_anti").unionByName(new).distinct()


def merge_zones(sets: DataFrame, merges: DataFrame, deleted: DataFrame) -> DataFrame:
    """(dealer_id, unit_id): zones of ``merges`` (dealer_id, into) get the name of ``into``; ``deleted`` zones drop out first."""
    left = sets.join(deleted.select("dealer_id"), "dealer_id", "left_anti").join(merges, "dealer_id", "left")
    return left.select(F.coalesce("into", "dealer_id").alias("dealer_id"), "unit_id").distinct()


def moved_stores(kinded: DataFrame, store_units: DataFrame, picked: DataFrame) -> DataFrame:
    """Stores of ``kinded`` (store_id, dealers, direct, upstream, kind) that proposals move, with new_dealers and new_kind: those
    in a picked unit that src holds and dst does not. ``store_units``: (store_id, unit_id)."""
    at = kinded.join(store_units, "store_id").join(picked, "unit_id")
    moved = at.where(F.array_contains("dealers", F.col("src")) & ~F.array_contains("dealers", F.col("dst")))
    after = F.concat(F.array_remove("dealers", F.col("src")), F.array("dst"))
    return moved.withColumn("new_dealers", after).withColumn("new_kind", kind(F.col("new_dealers"), F.col("direct"), F.col("upstream")))


def move_impact(proposals: DataFrame, kinded: DataFrame, moved: DataFrame, areas: DataFrame) -> DataFrame:
    """(proposal_id, side, stores_before, stores_after, n_ok, n_oof, n_multi, n_direct_in, density) for src and dst of each
    proposal that moves a store; kinds are those that the stores of that side have after it. ``areas``: (dealer_id, area_km2)."""
    held = kinded.select("store_id", F.explode("dealers").alias("dealer_id"), "kind")
    sides = proposals.join(moved.select("proposal_id").distinct(), "proposal_id").select("proposal_id", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("dealer_id")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("dealer_id")))).alias("s")).select("proposal_id", "s.*")
    change = moved.select("proposal_id", "store_id", F.lit(True).alias("moves"))
    stay = sides.join(held, "dealer_id").join(change, ["proposal_id", "store_id"], "left").where("side = 'dst' OR moves IS NULL").select("proposal_id", "side", "kind", F.lit(1).alias("after"), F.lit(1).alias("before"))
    leave = moved.select("proposal_id", F.lit("src").alias("side"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("after"), F.lit(1).alias("before"))
    come = moved.select("proposal_id", F.lit("dst").alias("side"), F.col("new_kind").alias("kind"), F.lit(1).alias("after"), F.lit(0).alias("before"))
    counts = stay.unionByName(leave).unionByName(come).groupBy("proposal_id", "side").agg(F.sum("before").alias("stores_before"), F.sum("after").alias("stores_after"), *(F.count_if(F.col("kind") == k).alias(f"n_{k.lower()}") for k in ("OK", "OOF", "MULTI", "DIRECT_IN")))
    return sides.join(counts, ["proposal_id", "side"]).join(areas, "dealer_id").select("proposal_id", "side", "stores_before", "stores_after", "n_ok", "n_oof", "n_multi", "n_direct_in", F.round(F.col("stores_after") / F.col("area_km2"), 6).alias("density"))


def heads(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """(key, n, order): the first ``n`` rows of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).select(key, "n", order)


def applied(kinded: DataFrame, moved: DataFrame) -> DataFrame:
    """(store_id, dealers, kind) of every store after all moves; of several moves of one store the first proposal's counts."""
    once = moved.groupBy("store_id").agg(F.min_by(F.struct("new_dealers", "new_kind"), "proposal_id").alias("m"))
    return kinded.join(once, "store_id", "left").select("store_id", F.coalesce("m.new_dealers", "dealers").alias("dealers"), F.coalesce("m.new_kind", "kind").alias("kind"))


def compare(current: DataFrame, generated: DataFrame) -> DataFrame:
    """(dealer_id, now_covered, generated_covers, changed) from pairs (dealer_id, store_id) of both states."""
    a, b = current.distinct().withColumn("now", F.lit(1)), generated.distinct().withColumn("gen", F.lit(1))
    both = a.join(b, ["dealer_id", "store_id"], "full").select("dealer_id", F.coalesce("now", F.lit(0)).alias("now"), F.coalesce("gen", F.lit(0)).alias("gen"))
    return both.groupBy("dealer_id").agg(F.sum("now").alias("now_covered"), F.sum("gen").alias("generated_covers"), F.count_if(F.col("now") != F.col("gen")).alias("changed"))


def compare_cells(current: DataFrame, generated: DataFrame, stores: DataFrame) -> DataFrame:
    """As ``compare``, for a generated state that has whole cells: it holds each of ``stores`` (store_id, i, j) that lies in a cell of
    ``generated`` (dealer_id, i, j). ``current``: (dealer_id, store_id, i, j).

    Pairs of a dealer and a store of its cells are counted by cell, not made: where stores and dealers both grow, they grow with the square.
    """
    cell = ["i", "j"]
    now = current.groupBy("dealer_id", *cell).agg(F.count_distinct("store_id").alias("now"))
    sizes = stores.groupBy(*cell).agg(F.count_distinct("store_id").alias("gen"))
    both = now.join(generated.distinct().join(sizes, cell), ["dealer_id", *cell], "full").fillna({"now": 0, "gen": 0})
    changed = F.when(F.col("gen") > 0, F.col("gen") - F.col("now")).otherwise(F.col("now"))  # a generated cell has all stores that the current state has there
    return both.groupBy("dealer_id").agg(F.sum("now").alias("now_covered"), F.sum("gen").alias("generated_covers"), F.sum(changed).alias("changed"))


def resolve_terms(terms: DataFrame, attributes: DataFrame) -> DataFrame:
    """(term_id, unit_id) of ``terms`` (term_id, term). ``attributes``: (kind_rank, name, unit_id), kinds in order of search.

    "a 沿 b" is the intersection of both sides' units, or their union if a side has none; each side, as a plain term, is the
    units of the first kind that knows the name. Equal texts are resolved once.
    """
    texts = terms.select("term").distinct().withColumn("parts", F.split("term", "沿", 2))
    sides = texts.select("term", F.size("parts").alias("sides"), F.posexplode("parts").alias("p", "name")).withColumn("name", F.trim("name"))
    units = attributes.select("kind_rank", "name", "unit_id").join(sides.select("name").distinct(), "name", "left_semi").distinct()
    best = units.groupBy("name").agg(F.min("kind_rank").alias("kind_rank"))
    known = sides.join(best, "name")
    texts_known = known.groupBy("term").agg(F.count("*").alias("known"))
    per = known.join(units, ["name", "kind_rank"]).groupBy("term", "sides", "unit_id").agg(F.count("*").alias("n"))
    found = per.join(texts_known, "term").where("sides = 1 OR known = 1 OR n = 2").select("term", "unit_id")
    return terms.select("term_id", "term").join(found, "term").select("term_id", "unit_id")


def uncovered(units: DataFrame, covered: DataFrame) -> DataFrame:
    """(district, n): units of no fence, by district."""
    return units.join(covered.select("unit_id").distinct(), "unit_id", "left_anti").groupBy("district").agg(F.count("*").alias("n"))
