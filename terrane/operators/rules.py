"""Gap rules: magnitude, materiality, triggers and routes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import ship

#: Materiality weights, level cuts in rising order, and levels.
W_MAGNITUDE, W_SEVERITY, W_PERSISTENCE, W_STRATEGIC, FULL_PERSISTENCE = 0.40, 0.30, 0.20, 0.10, 4
LEVELS = [("Informational", 0.0), ("Monitor", 0.15), ("Review", 0.35), ("Actionable", 0.50), ("Critical", 0.80)]
MIN_CONFIDENCE, IDENTITY_LIMIT = 0.5, 0.05
# What a trigger decides, the level from which on it may create a case, and its defaults.
CREATE, MONITOR, EVIDENCE, NO_ACTION = "CreateDecisionCase", "Monitor", "RequestMoreEvidence", "NoAction"
GATE, MIN_PERSISTENCE, CONFIDENCE_GATE = "Actionable", 2, 0.6
# What a level alone leads to; all others need no action.
BY_LEVEL = {"Review": EVIDENCE, "Monitor": MONITOR}
# Subtypes and the type they belong to; those of identity belong to none.
SUBTYPES = {
    "CoverageAllocationGap": "CoverageGap", "SchedulingCoverageGap": "CoverageGap", "ExecutionCoverageGap": "CoverageGap",
    "CapacityGlobalGap": "CapacityGap", "CapacityLocalGap": "CapacityGap", "CapacityResourceTypeGap": "CapacityGap", "CapacityTemporalGap": "CapacityGap",
    "OpportunityUnserved": "OpportunityGap", "OpportunityUnderServed": "OpportunityGap", "OpportunityMisallocated": "OpportunityGap",
    "SpatialTravelBaseLocation": "SpatialTravelGap", "SpatialTravelTerritoryShape": "SpatialTravelGap", "SpatialTravelRoadNetwork": "SpatialTravelGap",
    "SpatialTravelCrossBoundary": "SpatialTravelGap", "SpatialTravelRouteStructure": "SpatialTravelGap",
    "IdentityDuplicate": None, "IdentityFalseMatch": None, "IdentityUnresolved": None, "HierarchyMisattribution": None,
}
# What a diagnosis is routed to.
ROUTES = {
    "CapacityShortage": "DP01 Resource Sizing",
    "CapacitySurplus": "DP01 Resource Sizing",
    "ResourceLocationMismatch": "DP02 Resource Location",
    "TerritoryImbalance": "DP03 Territory Alignment",
    "CapabilityMismatch": "DP04 Personnel Matching",
    "PersonnelConstraint": "DP04 Personnel Matching",
    "CoveragePolicyMismatch": "DP05 Coverage Allocation",
    "CoverageAllocationMismatch": "DP05 Coverage Allocation",
    "SchedulingInfeasibility": "DP06 Visit Scheduling",
    "RoutingInefficiency": "DP07 Daily Routing",
    "DataQualityIssue": "World Model Repair",
    "ModelQualityIssue": "Model Governance",
    "PolicyConflict": "Policy Review",
}
REPAIR = "World Model Repair"


def lookup(names: dict[str, str | None], key: Column) -> Column:
    """The value of a small fixed table; null for unknown keys."""
    return F.element_at(F.create_map(*(F.lit(v) for kv in names.items() for v in kv)), key)


def magnitude(gap: Column, reference: Column) -> Column:
    """min(|gap| / |reference|, 1)."""
    return F.least(F.abs(gap) / F.greatest(F.abs(reference), F.lit(1e-12)), F.lit(1.0))


def normalised(gaps: DataFrame) -> DataFrame:
    """Fills gap_value = observed - reference where it is missing, and adds problem: the first of no_id, confidence, severity
    (not in [0, 1]), unknown_subtype and subtype_of_other_type that holds, else null. Identity subtypes fit any type.

    ``gaps``: (gap_id, gap_type, subtype, observed, reference, gap_value, severity, confidence).
    """
    out_of_range = lambda c: ~F.coalesce(F.col(c).between(0, 1), F.lit(False))
    identity = F.col("subtype").isin([k for k, v in SUBTYPES.items() if v is None])
    problem = (
        F.when(F.coalesce(F.col("gap_id").cast("string"), F.lit("")) == "", "no_id")
        .when(out_of_range("confidence"), "confidence")
        .when(out_of_range("severity"), "severity")
        .when(F.col("subtype").isNotNull() & ~F.col("subtype").isin(list(SUBTYPES)), "unknown_subtype")
        .when(F.col("subtype").isNotNull() & ~identity & ~F.coalesce(lookup(SUBTYPES, F.col("subtype")) == F.col("gap_type"), F.lit(False)), "subtype_of_other_type")
    )
    return gaps.withColumn("gap_value", F.coalesce("gap_value", F.col("observed") - F.col("reference"))).withColumn("problem", problem)


def level_rank(level: Column) -> Column:
    return F.coalesce(*(F.when(level == name, k) for k, (name, _) in enumerate(LEVELS)))


def level_name(rank: Column) -> Column:
    return F.get(F.array(*(F.lit(name) for name, _ in LEVELS)), rank)


def materiality(gaps: DataFrame) -> DataFrame:
    """Adds score, level and caps to ``gaps`` (gap_value, reference, severity, persistence, strategic, confidence, value).

    Low confidence and a value that isn't positive (null: not known) each cap the level at Review; caps names those that hold.
    """
    score = F.round(W_MAGNITUDE * magnitude(F.col("gap_value"), F.col("reference")) + W_SEVERITY * F.col("severity") + W_PERSISTENCE * F.least(F.col("persistence") / FULL_PERSISTENCE, F.lit(1.0)) + W_STRATEGIC * F.col("strategic"), 9)
    rank = sum(((F.col("score") >= cut).cast("int") for _, cut in LEVELS[1:]), F.lit(0))
    capped = F.least(rank, F.when(F.col("confidence") < MIN_CONFIDENCE, 2).otherwise(4), F.when(F.col("value") <= 0, 2).otherwise(4))
    caps = F.array_compact(F.array(F.when(F.col("confidence") < MIN_CONFIDENCE, "confidence_floor"), F.when(F.col("value") <= 0, "edv_nonpositive")))
    return gaps.withColumn("score", score).withColumn("level", level_name(capped)).withColumn("caps", caps)


def identity_capped(gaps: DataFrame) -> DataFrame:
    """Caps the level at Review in scopes where more than IDENTITY_LIMIT of the rows have an identity problem."""
    ratio = gaps.groupBy("scope").agg(F.avg(F.col("identity_problem").cast("double")).alias("identity_ratio"))
    joined = gaps.join(ratio, "scope")
    return joined.withColumn("level", F.when(F.col("identity_ratio") > IDENTITY_LIMIT, level_name(F.least(level_rank(F.col("level")), F.lit(2)))).otherwise(F.col("level")))


def persistence(observed: DataFrame, span: int = 4096) -> DataFrame:
    """Adds persistence: how many periods in a row up to this one the scope has been in ``breach``, 0 outside one.

    ``observed``: (scope, n, breach), n the number of the period. A run starts after a period that isn't in breach or wasn't
    observed. Periods are worked on in ranges of ``span``, so a scope of any length is dealt to many tasks.
    """
    own = Window.partitionBy("scope", "_span").orderBy("n")
    rows = observed.withColumn("_span", F.expr(f"n div {span}"))
    again = ~F.lag("breach").over(own) | (F.lag("n").over(own) < F.col("n") - 1)  # null in a range's first row
    rows = rows.withColumn("_start", F.when(F.col("breach") & again, F.col("n")))
    rows = rows.withColumn("_start", F.max("_start").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = rows.groupBy("scope", "_span").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.min_by("breach", "n").alias("opens"), F.max_by("breach", "n").alias("closes"), F.max_by("_start", "n").alias("start"))
    order = Window.partitionBy("scope").orderBy("_span")  # a row for each range
    goes_on = F.coalesce(F.col("opens") & F.lag("closes").over(order) & (F.lag("last").over(order) == F.col("first") - 1), F.lit(False))
    spans = spans.withColumn("goes_on", goes_on).withColumn("begun", F.coalesce("start", F.when(~F.col("goes_on"), F.col("first"))))
    earlier = F.max("begun").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("scope", "_span", F.when(F.col("goes_on"), earlier).otherwise(F.col("first")).alias("_before"))
    rows = rows.join(spans, ["scope", "_span"])
    return rows.select(*observed.columns, F.when(F.col("breach"), F.col("n") - F.coalesce("_start", "_before") + 1).otherwise(0).alias("persistence"))


def trigger_policy(policies: DataFrame) -> DataFrame:
    """Adds exit, half the entry threshold where none is given, gate, always GATE, and problem: exit_above_entry or
    confidence_gate (not in [0, 1])."""
    out = policies.withColumn("exit", F.coalesce("exit", F.col("entry") / 2)).withColumn("gate", F.lit(GATE))
    return out.withColumn("problem", F.when(F.col("exit") > F.col("entry"), "exit_above_entry").when(~F.coalesce(F.col("confidence_gate").between(0, 1), F.lit(False)), "confidence_gate"))


def route_of_level(level: Column) -> Column:
    """Output of a materiality level alone."""
    return F.coalesce(lookup(BY_LEVEL, level), F.lit(NO_ACTION))


def decide(gap: Column, p: dict[str, Column]) -> Column:
    """Struct of decision and reason. The reasons are looked at in this order: exit (the gap is at or below it), cooldown
    (Critical passes), materiality (the level is below the gate: its own output), confidence, persistence, entry, band.

    ``p``: entry, exit, cooldown_left, level, gate, confidence, confidence_gate, persistence, min_persistence.
    """
    out = lambda decision, reason: F.struct((F.lit(decision) if isinstance(decision, str) else decision).alias("decision"), F.lit(reason).alias("reason"))
    return (
        F.when(gap <= p["exit"], out(NO_ACTION, "exit"))
        .when((p["cooldown_left"] > 0) & (p["level"] != "Critical"), out(NO_ACTION, "cooldown"))
        .when(level_rank(p["level"]) < level_rank(p["gate"]), out(route_of_level(p["level"]), "materiality"))
        .when(p["confidence"] < p["confidence_gate"], out(EVIDENCE, "confidence"))
        .when(p["persistence"] < p["min_persistence"], out(MONITOR, "persistence"))
        .when(gap >= p["entry"], out(CREATE, "entry"))
        .otherwise(out(MONITOR, "band"))
    )


class Trigger:
    """A trigger's thresholds, and the states of a scope that they tell apart: periods in a row above the exit, up to the
    persistence asked for, and periods of cooldown left. ``idle``: a scope not observed for more periods starts afresh."""

    def __init__(self, entry: float, exit_: float | None = None, min_persistence: int = MIN_PERSISTENCE, cooldown: int = 0, confidence_gate: float = CONFIDENCE_GATE, gate: str = GATE, idle: int | None = None):
        self.entry, self.exit = entry, entry / 2 if exit_ is None else exit_
        if self.exit > self.entry or not 0 <= confidence_gate <= 1:
            raise ValueError("the exit threshold is above the entry threshold, or the confidence gate isn't in [0, 1]")
        self.min_persistence, self.cooldown, self.confidence_gate, self.idle = min_persistence, cooldown, confidence_gate, idle
        self.ranks = {name: k for k, (name, _) in enumerate(LEVELS)}
        self.gate = self.ranks[gate]
        self.states = (min_persistence + 1) * (cooldown + 1)

    def state(self, run, left):
        return run * (self.cooldown + 1) + left

    def aged(self, state, periods: int):
        """``state`` once ``periods`` periods have passed without an observation."""
        run, left = np.divmod(state, self.cooldown + 1)
        if self.idle is not None and periods >= self.idle:
            return np.zeros_like(state)
        return self.state(run, np.maximum(0, left - periods))

    def step(self, state, gap: float, level: str, confidence: float):
        """(state for the next period, decision, reason) of one period from a state, or from an array of states at once."""
        run, left = np.divmod(np.asarray(state), self.cooldown + 1)
        rank = self.ranks[level]
        run = np.minimum(run + 1, self.min_persistence) if gap > self.exit else np.zeros_like(run)
        ready = gap > self.exit and rank >= self.gate and confidence >= self.confidence_gate and gap >= self.entry
        made = ready & (run >= self.min_persistence) & ((left == 0) | (level == "Critical"))
        after = self.state(run, np.where(made, self.cooldown, np.maximum(0, left - 1)))
        if np.ndim(state):
            return after, None, None
        if gap <= self.exit:
            said = NO_ACTION, "exit"
        elif left > 0 and level != "Critical":
            said = NO_ACTION, "cooldown"
        elif rank < self.gate:
            said = BY_LEVEL.get(level, NO_ACTION), "materiality"
        elif confidence < self.confidence_gate:
            said = EVIDENCE, "confidence"
        elif run < self.min_persistence:
            said = MONITOR, "persistence"
        else:
            said = (CREATE, "entry") if made else (MONITOR, "band")
        return int(after), *said

    def fold(self, state, last: int | None, rows: Iterable[tuple]):
        """(state, last period, [(n, decision, reason)]) after rows (n, gap, level, confidence) in order; ``state`` is meant for the
        period after ``last``. An array of states gives no decisions."""
        out = []
        for n, gap, level, confidence in rows:
            if last is not None and n > last + 1:
                state = self.aged(state, n - last - 1)
            state, decision, reason = self.step(state, gap, level, confidence)
            last = n
            out.append((n, decision, reason))
        return state, last, out


DECISIONS = "scope long, n long, decision string, reason string"


def fold_cooldown(observed: DataFrame, trigger: Trigger, span: int = 2048) -> DataFrame:
    """(scope, n, decision, reason): what ``trigger`` decides in order of period per scope, where a created case starts a
    cooldown that later decisions see. ``observed``: (scope, n, gap, level, confidence), one row a period.

    Periods are cut into ranges of ``span``. A range is a map from the state before it to the state after it, found for all
    states at once; a scope's maps, a few numbers for each range, are applied in order, so that each range knows its state;
    then ranges are folded apart. A scope of any length is dealt to many tasks, none of which holds more than a range, or
    the maps of one scope.
    """
    ship(observed.sparkSession)
    ranged = observed.select("scope", "n", "gap", "level", "confidence", F.expr(f"n div {span}").alias("span"))

    def rows(pdf: pd.DataFrame) -> Iterable[tuple]:
        pdf = pdf.sort_values("n")
        return zip(pdf["n"].tolist(), pdf["gap"].tolist(), pdf["level"].tolist(), pdf["confidence"].tolist(), strict=True)

    def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
        state, last, _ = trigger.fold(np.arange(trigger.states), None, rows(pdf))
        return pd.DataFrame({"scope": pdf["scope"].iloc[:1], "span": pdf["span"].iloc[:1], "first": [pdf["n"].min()], "last": [last], "after": [state.tolist()]})

    def carried(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, last, before = pdf.sort_values("span"), 0, None, []
        for first, end, after in zip(pdf["first"].tolist(), pdf["last"].tolist(), pdf["after"].tolist(), strict=True):
            state = state if last is None or first == last + 1 else int(trigger.aged(state, first - last - 1))
            before.append(state)
            state, last = after[state], end
        return pd.DataFrame({"scope": pdf["scope"], "span": pdf["span"], "state": before})

    def told(own: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        _, _, out = trigger.fold(int(before["state"].iloc[0]), None, rows(own))
        return pd.DataFrame([(own["scope"].iloc[0], *x) for x in out], columns=["scope", "n", "decision", "reason"])

    maps = ranged.groupBy("scope", "span").applyInPandas(mapped, "scope long, span long, first long, last long, after array<long>")
    states = maps.groupBy("scope").applyInPandas(carried, "scope long, span long, state long")
    return ranged.groupBy("scope", "span").cogroup(states.groupBy("scope", "span")).applyInPandas(told, DECISIONS)


def route(diagnoses: DataFrame, limit: float = IDENTITY_LIMIT) -> DataFrame:
    """Adds output, route and alternative to ``diagnoses`` (diagnosis, unresolved): NoGap needs no action; identity subtypes go
    to repair; known ones by ROUTES, with repair as alternative if the unresolved share is above ``limit``; all others, null
    included, need more evidence."""
    d = F.col("diagnosis")
    known = F.when(d.isin([k for k, v in SUBTYPES.items() if v is None]), REPAIR).otherwise(lookup(ROUTES, d))
    out = F.when(d == "NoGap", "NoAction").when(known.isNotNull(), "Route").otherwise("RequestMoreEvidence")
    also = F.when(lookup(ROUTES, d).isNotNull() & (F.col("unresolved") > limit), REPAIR)
    return diagnoses.withColumns({"output": out, "route": known, "alternative": also})


def route_of_decision(decision: Column) -> Column:
    """Output of a trigger's decision, which is passed on; ERROR for one that creates a case, which needs a diagnosis first."""
    return F.when(decision.isin(MONITOR, EVIDENCE, NO_ACTION), decision).otherwise("ERROR")
