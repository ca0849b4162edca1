"""Records of one entity from several sources: blocking, pair scores, clusters, surviving attributes, versions and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.operators import scans

from terrane.operators.graph import labelled

#: Bands of the pair score: from MATCH on one entity, below UNCERTAIN two; and the weights of name, place and contact.
MATCH, UNCERTAIN = 0.85, 0.55
WEIGHTS = {"name": 0.5, "place": 0.2, "contact": 0.3}


def candidates(records: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """(a, b): distinct pairs of ``records`` (record_id, source, ...) of different sources that share one of the block ``keys``
    (null keys share nothing). Each key is an equi-join; a < b.

    A record is filed for each smaller source of its block, so records of one source never meet, however many share a block. A
    pair counts under the first key that it shares, so pairs are made once.
    """
    own = records.select("record_id", "source", F.array(*(c.cast("string") for c in keys.values())).alias("keys"))
    blocks = own.select("record_id", "source", "keys", F.posexplode("keys").alias("nth", "block")).where("block IS NOT NULL")
    smaller = blocks.select("nth", "block", F.col("source").alias("with")).distinct()
    other = blocks.join(smaller, ["nth", "block"]).where("with < source").select("nth", "block", F.col("with").alias("source"), F.col("record_id").alias("other"), F.col("keys").alias("their"))
    earlier = [(F.col("nth") > k) & F.coalesce(F.get("keys", F.lit(k)) == F.get("their", F.lit(k)), F.lit(False)) for k in range(len(keys) - 1)]
    met = blocks.join(other, ["nth", "block", "source"]).where(F.col("record_id") != F.col("other"))
    for seen in earlier:
        met = met.where(~seen)
    return met.select(F.least("record_id", "other").alias("a"), F.greatest("record_id", "other").alias("b"))


def recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: candidate pairs, true pairs, true pairs found and their share. ``truth``: (record_id, entity)."""
    per = truth.groupBy("entity").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("true_pairs"))
    e = lambda c: truth.select(F.col("record_id").alias(c), F.col("entity").alias(f"e_{c}"))
    found = pairs.join(e("a"), "a").join(e("b"), "b").agg(F.count("*").alias("pairs"), F.count_if(F.col("e_a") == F.col("e_b")).alias("found"))
    return found.crossJoin(per).select("pairs", "true_pairs", "found", F.round(F.col("found") / F.col("true_pairs"), 9).alias("recall"))  # one row each


def scored(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(a, b, score, band) of ``pairs``: names by edit distance, places and contacts by equality, missing values count nothing.
    ``records``: (record_id, name, place, contact)."""
    side = lambda c: records.select(F.col("record_id").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in WEIGHTS))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    longest = F.greatest(F.length("name_a"), F.length("name_b"), F.lit(1))
    alike = F.coalesce(1 - F.levenshtein("name_a", "name_b") / longest, F.lit(0.0))
    same = lambda c: F.coalesce((F.col(f"{c}_a") == F.col(f"{c}_b")).cast("double"), F.lit(0.0))
    score = F.round(WEIGHTS["name"] * alike + WEIGHTS["place"] * same("place") + WEIGHTS["contact"] * same("contact"), 9)
    return j.select("a", "b", score.alias("score"), F.when(score >= MATCH, "MATCH").when(score >= UNCERTAIN, "UNCERTAIN").otherwise("NON_MATCH").alias("band"))


def clusters(records: DataFrame, matches: DataFrame) -> DataFrame:
    """(record_id, label, cluster, conflict): components of ``matches`` (a, b). A component whose records have different
    contacts is a conflict, and its records stay apart: no chaining that nobody has checked."""
    nodes = records.select(F.lit(0).alias("all"), F.col("record_id").alias("unit_id"))
    label = labelled(nodes, matches.select(F.lit(0).alias("all"), "a", "b"), ["all"]).select(F.col("unit_id").alias("record_id"), "label")
    own = records.select("record_id", "contact").join(label, "record_id")
    bad = own.groupBy("label").agg((F.count_distinct("contact") > 1).alias("conflict"))
    return own.join(bad, "label").select("record_id", "label", F.when(F.col("conflict"), F.col("record_id")).otherwise(F.col("label")).alias("cluster"), "conflict")


def survivors(records: DataFrame) -> DataFrame:
    """One row for each cluster of ``records`` (cluster, record_id, source, name, place, contact, updated): the commonest name (of equal ones the first),
    the place of the latest record, the contact of the most trusted source (the first by name) that has one."""
    names = records.where("name IS NOT NULL").groupBy("cluster", "name").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("name"))
    rest = records.groupBy("cluster").agg(F.count("*").alias("records"), F.max_by("place", F.when(F.col("place").isNotNull(), F.struct("updated", "record_id"))).alias("place"), F.min_by("contact", F.when(F.col("contact").isNotNull(), F.struct("source", "record_id"))).alias("contact"))
    return rest.join(names, "cluster", "left")


def as_of(versions: DataFrame, asked: DataFrame, key: str, value: str, rows: int = scans.ROWS) -> DataFrame:
    """(asked columns, version, value): what was known at each of ``asked`` (ask_id, key, at): the version of latest valid_from
    among those both valid and recorded by then, of equal ones the largest id. ``versions``: (key, version, valid_from, recorded, value).

    A version counts from the later of its two times on, so one sort by key and time and a running maximum answer all
    questions; nothing recorded later is looked at. The maximum is carried over ranges of time of about ``rows`` rows, so one
    key may hold any share of them.
    """
    v = versions.select(key, F.greatest("valid_from", "recorded").alias("t"), F.lit(0).alias("ask"), F.lit(None).cast("long").alias("ask_id"), F.struct("valid_from", "version", F.col(value).alias("value")).alias("v"))
    q = asked.select(key, F.col("at").alias("t"), F.lit(1).alias("ask"), F.col("ask_id").cast("long").alias("ask_id"), F.lit(None).cast(v.schema["v"].dataType).alias("v"))
    both, span = scans.ranged(v.unionByName(q).withColumn("_at", F.col("t").cast("timestamp").cast("double")), "_at", rows)
    both = scans.running(both, [key], ["t", "ask"], span, {"known": ("max", F.col("v"), True)})
    return both.where("ask = 1").select("ask_id", key, F.col("known.version").alias("version"), F.col("known.value").alias(value))


def agreement(assigned: DataFrame) -> DataFrame:
    """One row of pairwise and B-cubed precision and recall of ``assigned`` (record_id, cluster, entity), from the sizes of
    clusters, entities and what they share; no pairs are made."""
    cell = assigned.groupBy("cluster", "entity").agg(F.count("*").cast("double").alias("n"))
    both = cell.withColumns({"c": F.sum("n").over(Window.partitionBy("cluster")), "e": F.sum("n").over(Window.partitionBy("entity"))})
    pairs = lambda n: n * (n - 1) / 2
    n = F.col("n")
    s = both.agg(F.sum(pairs(n)).alias("hit"), F.sum(n * (F.col("c") - 1) / 2).alias("said"), F.sum(n * (F.col("e") - 1) / 2).alias("true"), F.sum(n * n / F.col("c")).alias("bp"), F.sum(n * n / F.col("e")).alias("br"), F.sum("n").alias("all"))
    share = lambda a, b, name: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(1.0), 9).alias(name)
    return s.select(share("hit", "said", "pair_precision"), share("hit", "true", "pair_recall"), share("bp", "all", "b3_precision"), share("br", "all", "b3_recall"))
