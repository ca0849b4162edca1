"""Workload, representatives needed, balance and its greedy improvement."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import stored


def loads(accounts: DataFrame) -> DataFrame:
    """(territory_id, load): minutes per year of each territory of ``accounts`` (territory_id, calls, minutes)."""
    return accounts.groupBy("territory_id").agg(F.sum(F.col("calls") * F.col("minutes")).alias("load"))


def required_reps(minutes: Column, capacity: float) -> Column:
    return F.when(minutes <= 0, 0).otherwise(F.ceil(minutes / capacity)).cast("bigint")


def eq_index(load: DataFrame) -> DataFrame:
    """One row: (sum x)^2 / (n sum x^2); 1 for one territory or no load. Territories without load count in n."""
    s = load.agg(F.sum("load").cast("double").alias("s"), F.sum(F.col("load").cast("double") * F.col("load")).alias("ss"), F.count("*").alias("n"))
    return s.select("n", F.round(F.when((F.col("n") <= 1) | (F.coalesce("s", F.lit(0.0)) <= 0), 1.0).otherwise(F.col("s") * F.col("s") / (F.col("n") * F.col("ss"))), 9).alias("eq"))


def balance(load: DataFrame, capacity: float) -> DataFrame:
    """One row: total, reps on the total and summed over territories, equality, and max/min load (null if one is 0)."""
    s = load.agg(F.sum("load").alias("total"), F.sum(required_reps(F.col("load"), capacity)).alias("reps_by_territory"), F.max("load").alias("hi"), F.min("load").alias("lo"))
    return s.crossJoin(eq_index(load)).select("total", required_reps(F.col("total"), capacity).alias("reps_on_total"), "reps_by_territory", "eq", F.round(F.when(F.col("lo") > 0, F.col("hi") / F.col("lo")), 9).alias("max_min"))  # one row each


def nearby(sites: DataFrame, radius_km: float, k: int) -> DataFrame:
    """(territory_id, near_id, distance, rank): the ``k`` nearest others with headroom within the radius.

    ``sites`` (territory_id, x_km, y_km, headroom) meet by grid cells that hold about k + 1 of those with headroom at first. A
    site is done once ``k`` others are nearer than a cell is wide, since all that near have been met; the rest meet cells
    four times as wide, up to the radius. Rank by distance rounded to 4 digits, then id; the radius holds for the unrounded distance.
    """
    sites = stored(sites.select("territory_id", "x_km", "y_km", "headroom"), "sites")
    free = sites.where("headroom > 0").select(F.col("territory_id").alias("near_id"), F.col("x_km").alias("nx"), F.col("y_km").alias("ny"))
    box = free.agg(F.count("*").alias("n"), F.greatest(F.max("nx") - F.min("nx"), F.max("ny") - F.min("ny")).cast("double").alias("span")).first()
    width = min(radius_km, box.span or radius_km) * min(1.0, math.sqrt((k + 1) / max(box.n, 1)))  # a crowd may be as narrow as the radius
    left, out = sites.select("territory_id", "x_km", "y_km"), None
    per = Window.partitionBy("territory_id")
    while True:
        cell = lambda c: F.floor(F.col(c) / width)  # noqa: B023, E731
        around = F.explode(F.array(*(F.struct((cell("nx") + dx).alias("kx"), (cell("ny") + dy).alias("ky")) for dx in (-1, 0, 1) for dy in (-1, 0, 1))))
        near = free.withColumn("c", around).select("near_id", "nx", "ny", "c.kx", "c.ky")
        pairs = left.withColumns({"kx": cell("x_km"), "ky": cell("y_km")}).join(near, ["kx", "ky"]).where("near_id <> territory_id")
        d = F.sqrt(F.pow(F.col("x_km") - F.col("nx"), 2) + F.pow(F.col("y_km") - F.col("ny"), 2))
        pairs = pairs.withColumn("d", d).where(F.col("d") <= radius_km).withColumn("distance", F.bround("d", 4))
        sure = F.count_if(F.col("d") <= width - 2e-4).over(per)  # nearer than all not met yet, also when rounded
        met = pairs.withColumns({"rank": F.row_number().over(per.orderBy("distance", "near_id")), "sure": sure}).where(F.col("rank") <= k)
        met = stored(met.select("territory_id", "near_id", "distance", "rank", "sure"), "nearby")
        last = width >= radius_km
        done = (met if last else met.where(F.col("sure") >= k)).drop("sure")
        out = done if out is None else out.unionByName(done)
        if last:
            return out
        left = stored(left.join(done.select("territory_id").distinct(), "territory_id", "left_anti"), "left")
        if not left.limit(1).count():
            return out
        width = min(4 * width, radius_km)


def rebalance(accounts: DataFrame, moves: int = 5) -> DataFrame:
    """(scope, step, account_id, src, dst, eq): up to ``moves`` moves per scope, each the largest account of the most loaded
    territory to the least loaded one, as long as equality rises; ties go to smaller ids. A scope with fewer than two loaded
    territories has no moves. ``accounts``: (scope, account_id, territory_id, load).

    Only each territory's load and its ``moves`` largest accounts matter, since no more can leave it; these are worked out
    first, and a scope is planned on them in one task.
    """
    sums = accounts.groupBy("scope", "territory_id").agg(F.sum(F.col("load").cast("double")).alias("total"))
    order = Window.partitionBy("scope", "territory_id").orderBy(F.desc("load"), "account_id")
    top = accounts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= moves).select("scope", "territory_id", "account_id", F.col("load").cast("double").alias("load"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        total = dict(zip(pdf["territory_id"], pdf["total"], strict=True))
        own = {t: dict(zip(g["account_id"], g["load"], strict=True)) for t, g in pdf[pdf["account_id"].notna()].groupby("territory_id")}
        equality = lambda v: 1.0 if len(v) <= 1 or sum(v) <= 0 else sum(v) ** 2 / (len(v) * sum(x * x for x in v))
        rows, now = [], equality(total.values())
        for step in range(1, moves + 1 if sum(x > 0 for x in total.values()) >= 2 else 1):
            src, dst = min(total, key=lambda t: (-total[t], t)), min(total, key=lambda t: (total[t], t))
            best = min(((-load, a) for a, load in own.get(src, {}).items()), default=None)
            if src == dst or best is None or total[src] <= 0:
                break
            after = total | {src: total[src] + best[0], dst: total[dst] - best[0]}
            new = equality(after.values())
            if new - now <= 1e-12:
                break
            own.setdefault(dst, {})[best[1]] = own[src].pop(best[1])
            now, total = new, after
            rows.append((int(pdf["scope"].iloc[0]), step, int(best[1]), int(src), int(dst), round(new, 9)))
        return pd.DataFrame(rows, columns=["scope", "step", "account_id", "src", "dst", "eq"])

    return sums.join(top, ["scope", "territory_id"], "left").groupBy("scope").applyInPandas(plan, "scope long, step int, account_id long, src long, dst long, eq double")
