"""Operator 8 [native], mixing sources to target weights by Efraimidis-Spirakis sampling. Only DataFrame functions.

Each document gets the key -ln(u) / w: u is uniform by hash of its id and text, w its quality weight. Within a source the documents
of smallest key come first. A source that is to give more than it has is first taken whole as often as it fits (complete
epochs); the rest of its target is filled by a prefix in key order. The prefix is found by sums over intervals of keys, so
no source is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrane.llm.text import words
from terrane.session import stored

WEIGHTS, MAX_EPOCHS, SALT = (5, 2, 1), 3, "|mix|"
#: Documents of one source that one task puts in order, and parts that an interval of keys is cut into until they are so few.
PER_RANGE, BINS = 4096, 1024
STATE = ["s", "source_size", "target", "epochs", "rest", "lo", "hi", "start", "n", "prev"]


def keyed(documents: DataFrame) -> DataFrame:
    """All columns of ``documents`` (doc_id, text, source) and size, key and id (doc_id as text, for ties) as struct ``mix``.

    size: number of words, 0 for null. Quality weight: 1 less the share of symbols among the words, 0.1 at least.
    """
    size = F.size(words("text")).cast("long")
    text = F.coalesce("text", F.lit(""))
    inner = documents.withColumn("_size", size).withColumn("_symbols", F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    weight = F.lit(1.0) - F.least(F.lit(0.9), F.col("_symbols") / F.greatest(F.col("_size"), F.lit(1)))
    u = (F.conv(F.substring(F.md5(F.concat(name, F.lit(SALT), F.md5(text.cast("binary"))).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return inner.withColumn("mix", F.struct(F.col("_size").alias("size"), (-F.log(u) / weight).alias("key"), name.alias("id"))).drop("_size", "_symbols")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) and other columns from ``sizes`` (source, source_size, ...), one row per source.

    The limit of resharing any excess over ``epochs`` times a source's size by weight: target = min(cap, level * weight).
    Sources in order of cap / weight are at their cap as long as that is below the level that the remaining total and
    weights give. Runs on one row per source, in one task for all of them.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    named = sizes.withColumn("weight", pick).withColumn("cap", epochs * F.col("source_size"))
    by_level = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = named.withColumn("level", left / heavy).withColumn("free", F.col("cap") / F.col("weight") > F.col("level"))
    level = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    more = [c for c in sizes.columns if c not in ("source", "source_size")]
    return levels.withColumn("at", level).select("source", "source_size", *more, F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight"))).cast("double").alias("target"))


def _narrowed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``state`` with [lo, hi] cut to the one of BINS equal parts of it in which the target of each source is reached.

    start: words before lo; prev: the last (key, id) before lo; n: documents in [lo, hi].
    """
    here = rows.join(state, rows["source"].eqNullSafe(F.col("s"))).where("key between lo and hi")
    width = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS))
    bins = here.withColumn("bin", F.least(F.coalesce(width, F.lit(0)), F.lit(BINS - 1)))
    bins = bins.groupBy("s", "bin").agg(F.sum("size").alias("total"), F.count("*").alias("own"), F.min("key").alias("own_lo"), F.max("key").alias("own_hi"), F.max(F.struct("key", "id")).alias("last"))
    before = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # BINS rows at most
    bins = bins.withColumns({"earlier": F.coalesce(F.sum("total").over(before), F.lit(0)), "gone": F.max("last").over(before)}).withColumnRenamed("s", "_s")
    met = state.join(bins, state["s"].eqNullSafe(F.col("_s"))).where(F.col("start") + F.col("earlier") <= F.col("rest"))
    picked = met.groupBy("s").agg(F.max_by(F.struct("own_lo", "own_hi", "own", "earlier", "gone"), "bin").alias("p"))
    picked = picked.select(F.col("s").alias("_s"), "p")
    return state.join(picked, state["s"].eqNullSafe(F.col("_s"))).select(*STATE[:5], F.col("p.own_lo").alias("lo"), F.col("p.own_hi").alias("hi"), (F.col("start") + F.col("p.earlier")).alias("start"), F.col("p.own").alias("n"), F.coalesce("p.gone", "prev").alias("prev"))


def cuts(rows: DataFrame) -> DataFrame:
    """(source, source_size, target, epochs, cut, part) for each source of ``rows`` (source, mix): documents whose (key, id)
    is before or at ``cut`` are taken once more than ``epochs`` times; of those at it ``part``, or all if that is null. cut
    is null if none is.

    The cut is searched in the intervals of keys: each round sums the sizes of BINS parts of every source's interval and
    keeps one part, until PER_RANGE documents or documents of one key are left, which are put in order. Documents of
    equal key and id (repeated rows) are one row with a count there, however many they are.
    """
    rows = rows.select("source", "mix.*")
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("n")))
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    nothing = F.lit(None).cast("struct<key:double,id:string>")
    state = goal.select(F.col("source").alias("s"), "source_size", "target", "epochs", "rest", "lo", "hi", F.lit(0).cast("long").alias("start"), "n", nothing.alias("prev"))
    state = stored(state, "state")
    while state.where((F.col("n") > PER_RANGE) & (F.col("hi") > F.col("lo"))).limit(1).count():
        state = stored(_narrowed(rows, state), "state")
    near = rows.join(state, rows["source"].eqNullSafe(F.col("s"))).where("key between lo and hi").groupBy("s", "key", "id", "size").agg(F.count("*").alias("copies"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    within = Window.partitionBy("s").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("room", F.col("rest") - F.col("start") - F.coalesce(F.sum(F.col("copies") * F.col("size")).over(within), F.lit(0)))
    fits = F.when(F.col("size") > 0, F.floor(F.col("room") / F.col("size") + 0.5)).when(F.col("room") >= 0, F.col("copies")).otherwise(0)  # whose middle is within
    near = near.withColumn("fits", F.least("copies", fits)).where("fits > 0")
    last = near.groupBy("s").agg(F.max_by(F.struct(F.struct("key", "id").alias("cut"), F.when(F.col("fits") < F.col("copies"), F.col("fits")).alias("part")), F.struct("key", "id", "size")).alias("c")).withColumnRenamed("s", "_s")
    found = state.join(last, state["s"].eqNullSafe(F.col("_s")), "left")
    return found.select(F.col("s").alias("source"), "source_size", "target", "epochs", F.coalesce("c.cut", "prev").alias("cut"), F.col("c.part").alias("part"))


def taken(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """``rows`` (source, mix, ...) and struct ``_taken``: source_size, target and copies (how often the mix takes the document).

    ``chosen`` (one row per source) is written first: its size is then known when the join is planned, and Spark broadcasts
    it if that is below its threshold instead of shuffling ``rows`` by source. If a cut falls among repeated rows, these are
    counted by all their columns in a pass of their own and dealt out again, the first in order once more than the others.
    Other columns may have any name but ``_goal``, ``_taken``, ``_d``, ``_k`` and ``_i``.
    """
    goal = stored(chosen.select(F.struct("*").alias("_goal")), "cuts")
    cut, own = F.struct("_goal.cut.key", "_goal.cut.id"), F.struct("mix.key", "mix.id")
    joined = rows.join(goal, rows["source"].eqNullSafe(F.col("_goal.source")))
    split = F.coalesce(F.col("_goal.part").isNotNull() & (own == cut), F.lit(False))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    as_taken = lambda copies: F.struct("_goal.source_size", "_goal.target", copies.cast("int").alias("copies")).alias("_taken")
    copies = F.col("_goal.epochs") + F.coalesce(own <= cut, F.lit(False)).cast("int")
    if not goal.where("_goal.part is not null").limit(1).count():
        return joined.select(*columns, as_taken(copies))
    same = joined.where(split).groupBy(*columns, "_goal").agg(F.count("*").alias("_d"))
    before = Window.partitionBy("source").orderBy(F.to_json(F.struct(*columns))).rowsBetween(Window.unboundedPreceding, -1)
    again = F.greatest(F.lit(0), F.least(F.col("_d"), F.col("_goal.part") - F.coalesce(F.sum("_d").over(before), F.lit(0))))
    both = F.array(F.struct(again.alias("n"), (F.col("_goal.epochs") + 1).alias("copies")), F.struct((F.col("_d") - again).alias("n"), F.col("_goal.epochs").alias("copies")))
    dealt = same.select(*columns, "_goal", both.alias("_d")).withColumn("_d", F.explode("_d")).where("_d.n > 0")
    thousand = F.explode(F.sequence(F.lit(0), F.expr("(_d.n - 1) div 1000")))  # rows in thousands, so that many tasks deal them out
    dealt = dealt.select("*", thousand.alias("_k")).repartition("_k")
    each = F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("_d.n") - F.col("_k") * 1000))).alias("_i")
    dealt = dealt.select("*", each).select(*columns, as_taken(F.col("_d.copies")))
    return joined.where(~split).select(*columns, as_taken(copies)).unionByName(dealt)


def mix(documents: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source) of every document of ``documents`` (doc_id, text, source).

    taken is copies times size. A document crosses the end of its source's target if its middle is within, so that each
    source ends nearest to its target. Null sources are one source, last in order; null and empty texts have size 0 and are
    never taken words from; repeated rows are taken one by one, texts of one doc_id have keys of their own. An empty table
    gives no rows. Reruns agree.
    """
    rows = stored(keyed(documents.select("doc_id", "text", "source")).select("doc_id", "source", "mix"), "mix")
    out = taken(rows, cuts(rows))
    return out.select("doc_id", F.col("mix.size").alias("size"), "_taken.source_size", "_taken.target", (F.col("_taken.copies") * F.col("mix.size")).cast("long").alias("taken"), "source")


SQL_MIX = r"""
sized AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
            length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS symbols FROM documents),
keyed AS (SELECT *, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
            / (1.0::DOUBLE - least(0.9::DOUBLE, symbols / greatest(size, 1))) AS key FROM sized),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM keyed GROUP BY source),
cap AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM src),
lev AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
        FROM cap WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT arg_min(level, cap / weight) AS lv FROM lev WHERE cap / weight > level),
goal AS (SELECT source, source_size, CAST(coalesce(least(cap, lv * weight), cap) AS DOUBLE) AS target FROM lev, lvl),
mixed AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
            sum(size) OVER (PARTITION BY d.source ORDER BY key, CAST(doc_id AS VARCHAR), size ROWS UNBOUNDED PRECEDING) - size / 2 AS middle
          FROM keyed d JOIN goal g ON d.source IS NOT DISTINCT FROM g.source),
chosen AS (SELECT *, CAST(epochs + CASE WHEN middle <= target - epochs * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies FROM mixed)
"""
SQL = "WITH " + SQL_MIX + "SELECT doc_id, size, source_size, target, copies * size AS taken, source FROM chosen"
