"""Queries on gap rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrane import bindings as B
from terrane.bindings import sql
from terrane.operators import rules as R

#: Diagnoses in the order in which the binding deals them.
DIAGNOSES = ["NoGap", *R.ROUTES, "IdentityDuplicate", "HierarchyMisattribution", "Other"]
TYPES = ["CoverageGap", "CapacityGap", "OpportunityGap", "SpatialTravelGap", "CapabilityGap", "LocalAllocationGap", "StabilityGap"]
KINDS = [*R.SUBTYPES, "Unheard"]
TRIGGER = R.Trigger(0.3, 0.15, 2, 3, 0.3)


def _nth(names, k):
    return F.get(F.array(*map(F.lit, names)), k.cast("int"))


def observed(spark, d):
    """Gaps by scope and period with confidence and the like derived from both by whole numbers."""
    g = B.gaps(spark, d).withColumn("n", F.datediff("period", F.lit("2024-01-01").cast("date")).cast("long"))
    return g.withColumns({"gap_value": F.col("observed") - F.col("reference"), "severity": (F.col("scope") % 5) / 4, "confidence": (F.col("n") % 10) / 9, "strategic": (F.col("scope") % 2).cast("double"), "value": F.col("observed") - 3, "identity_problem": (F.col("scope") == 3) & (F.col("n") % 7 == 0), "breach": F.col("observed") > F.col("reference")})


def scored(spark, d):
    return R.materiality(R.persistence(observed(spark, d)))


def normalised(spark, d):
    """Gaps as records: every fifth with its gap given, some without id, some of a subtype that doesn't fit."""
    g = observed(spark, d).withColumn("gap_value", F.when(F.col("n") % 5 != 0, F.col("gap_value")))
    typed = {"gap_id": F.when(F.col("n") % 31 != 0, F.concat_ws("-", "scope", "n")), "gap_type": _nth(TYPES, F.col("n") % 4), "subtype": F.when(F.col("n") % 3 != 0, _nth(KINDS, (F.col("n") + F.col("scope")) % len(KINDS)))}
    return R.normalised(g.withColumns(typed)).select("scope", "n", F.round("gap_value", 6).alias("gap_value"), "problem")


def triggers(spark, d):
    """(scope, n, gap, level, confidence) as a trigger sees them."""
    return scored(spark, d).select("scope", "n", R.magnitude(F.col("gap_value"), F.col("reference")).alias("gap"), "level", "confidence")


def folded(spark, d):
    return R.fold_cooldown(triggers(spark, d), TRIGGER)


def decided(spark, d):
    """Decisions under the gate Actionable and, for comparison, under the gate Review."""
    g = scored(spark, d)
    p = {"exit": F.lit(0.15), "entry": F.lit(0.3), "cooldown_left": F.col("n") % 4 - 2, "level": F.col("level"), "confidence": F.col("confidence"), "confidence_gate": F.lit(0.3), "persistence": F.col("persistence"), "min_persistence": F.lit(2)}
    gap = R.magnitude(F.col("gap_value"), F.col("reference"))
    return g.select("scope", "n", "level", R.decide(gap, p | {"gate": F.lit(R.GATE)}).alias("d"), R.decide(gap, p | {"gate": F.lit("Review")}).alias("r"))


def policies(spark, d):
    """A trigger policy for each scope and period: some without an exit threshold, some with one above the entry."""
    g = observed(spark, d).select("scope", "n", F.round((F.col("scope") + 1) / 10, 2).alias("entry"), F.when(F.col("n") % 3 != 0, F.round((F.col("n") % 7) / 10, 2)).alias("exit"), F.round((F.col("n") % 12) / 10, 2).alias("confidence_gate"))
    return R.trigger_policy(g)


def routed(spark, d):
    g = B.gaps(spark, d)
    g = g.select("scope", "period", _nth(DIAGNOSES, (F.col("observed") + F.dayofmonth("period")) % len(DIAGNOSES)).alias("diagnosis"), (F.col("scope") / 100).alias("unresolved"))
    return R.route(g).select("scope", F.col("period").cast("string").alias("period"), "output", "route", "alternative")


def passed_on(spark, d):
    """What decisions and levels alone lead to."""
    return decided(spark, d).select("scope", "n", R.route_of_decision(F.col("d.decision")).alias("by_decision"), R.route_of_level(F.col("level")).alias("by_level"))


QUERIES = {
    "r1_normalised": normalised,
    "r2_magnitude": lambda s, d: observed(s, d).select("scope", "n", F.round(R.magnitude(F.col("gap_value"), F.col("reference")), 9).alias("magnitude")),
    "r3_materiality": lambda s, d: scored(s, d).select("scope", "n", "score", "level", F.array_join("caps", ",").alias("caps")),
    "r4_identity_cap": lambda s, d: R.identity_capped(scored(s, d)).select("scope", "n", "level"),
    "r5_trigger_policy": policies,
    "r6_trigger": lambda s, d: decided(s, d).select("scope", "n", "d.decision", "d.reason", F.col("r.decision").alias("decision_from_review"), F.col("r.reason").alias("reason_from_review")),
    "r7_route": routed,
    "r8_passed_on": passed_on,
    "w7_persistence": lambda s, d: R.persistence(observed(s, d)).select("scope", "n", F.col("persistence").cast("int").alias("persistence")),
    "w8_cooldown": folded,
}
_G = "SELECT scope, period, CAST(date_diff('day', DATE '2024-01-01', period) AS BIGINT) AS n, observed, reference, observed - reference AS gap_value, (scope % 5) / 4 AS severity, strategic, observed - 3 AS value, observed > reference AS breach FROM (SELECT *, CAST(scope % 2 AS DOUBLE) AS strategic FROM gap)"
_PERS = "SELECT *, CASE WHEN breach THEN row_number() OVER (PARTITION BY scope, breach, island ORDER BY n) ELSE 0 END AS persistence, (n % 10) / 9 AS confidence, least(abs(gap_value) / greatest(abs(reference), 1e-12), 1.0) AS mag FROM (SELECT *, n - row_number() OVER (PARTITION BY scope, breach ORDER BY n) AS island FROM g)"
_SCORE = "SELECT *, round(0.40::DOUBLE * mag + 0.30::DOUBLE * severity + 0.20::DOUBLE * least(persistence / 4, 1.0) + 0.10::DOUBLE * strategic, 9) AS score FROM pers"
_LEVEL = "SELECT *, least(CAST(score >= 0.15::DOUBLE AS INTEGER) + CAST(score >= 0.35::DOUBLE AS INTEGER) + CAST(score >= 0.50::DOUBLE AS INTEGER) + CAST(score >= 0.80::DOUBLE AS INTEGER), CASE WHEN confidence < 0.5 THEN 2 ELSE 4 END, CASE WHEN value <= 0 THEN 2 ELSE 4 END) AS lv FROM scored"
_NAME = "['Informational', 'Monitor', 'Review', 'Actionable', 'Critical'][{} + 1]"
_list = lambda names: "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in names) + "]"
_PARENTS, _TYPES = _list([*R.SUBTYPES.values(), None]), _list(TYPES)
_ROUTE = _list([None, *R.ROUTES.values(), R.REPAIR, R.REPAIR, None])
# The steps of a decision, each on its own line, for a row with mag, lv, confidence, the periods in a row and the cooldown left.
_STEPS = """CASE WHEN mag <= 0.15::DOUBLE THEN 'NoAction|exit'
    WHEN {left} > 0 AND lv < 4 THEN 'NoAction|cooldown'
    WHEN lv < {gate} THEN ['NoAction', 'Monitor', 'RequestMoreEvidence'][lv + 1] || '|materiality'
    WHEN confidence < 0.3::DOUBLE THEN 'RequestMoreEvidence|confidence'
    WHEN {run} < 2 THEN 'Monitor|persistence'
    WHEN mag >= 0.3::DOUBLE THEN 'CreateDecisionCase|entry' ELSE 'Monitor|band' END"""
_DECIDED = "SELECT scope, n, lv, " + _STEPS.format(left="(n % 4 - 2)", gate=3, run="persistence") + " AS d, " + _STEPS.format(left="(n % 4 - 2)", gate=2, run="persistence") + " AS r FROM leveled"
# The fold of a scope, a row at a time: until is the last period of the cooldown that the row sees.
_ORDERED = "SELECT scope, n, mag, lv, confidence, row_number() OVER (PARTITION BY scope ORDER BY n) AS k FROM leveled"
_FOLD = f"""SELECT scope, k, n, CAST(-1 AS BIGINT) AS until, CASE WHEN mag > 0.15::DOUBLE THEN 1 ELSE 0 END AS run, {_STEPS.format(left="0", gate=3, run="1")} AS d FROM ordered WHERE k = 1
UNION ALL SELECT scope, k, n, until, run, {_STEPS.format(left="(until - n + 1)", gate=3, run="run")} FROM
  (SELECT o.*, CASE WHEN f.d = 'CreateDecisionCase|entry' THEN f.n + 3 ELSE f.until END AS until, CASE WHEN o.mag > 0.15::DOUBLE THEN f.run + 1 ELSE 0 END AS run FROM fold f JOIN ordered o ON o.scope = f.scope AND o.k = f.k + 1)"""
_C = {"g": _G, "pers": _PERS, "scored": _SCORE, "leveled": _LEVEL}
SQL = {
    "r1_normalised": sql(f"SELECT scope, n, round(gap_value, 6) AS gap_value, CASE WHEN n % 31 = 0 THEN 'no_id' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence' WHEN severity NOT BETWEEN 0 AND 1 THEN 'severity' WHEN n % 3 <> 0 THEN CASE WHEN k = {len(KINDS)} THEN 'unknown_subtype' WHEN {_PARENTS}[k] IS NOT NULL AND {_PARENTS}[k] <> {_TYPES}[n % 4 + 1] THEN 'subtype_of_other_type' END END AS problem FROM (SELECT *, (n + scope) % {len(KINDS)} + 1 AS k FROM leveled)", **_C),
    "r5_trigger_policy": sql("SELECT *, CASE WHEN exit > entry THEN 'exit_above_entry' WHEN confidence_gate > 1 THEN 'confidence_gate' END AS problem FROM (SELECT scope, n, round((scope + 1) / 10, 2) AS entry, coalesce(CASE WHEN n % 3 <> 0 THEN round((n % 7) / 10, 2) END, round((scope + 1) / 10, 2) / 2) AS exit, round((n % 12) / 10, 2) AS confidence_gate, 'Actionable' AS gate FROM leveled)", **_C),
    "r2_magnitude": sql("SELECT scope, n, round(mag, 9) AS magnitude FROM pers", **_C),
    "r3_materiality": sql(f"SELECT scope, n, score, {_NAME.format('lv')} AS level, concat_ws(',', CASE WHEN confidence < 0.5 THEN 'confidence_floor' END, CASE WHEN value <= 0 THEN 'edv_nonpositive' END) AS caps FROM leveled", **_C),
    "r4_identity_cap": sql(f"SELECT scope, n, CASE WHEN avg(CASE WHEN scope = 3 AND n % 7 = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY scope) > 0.05 THEN {_NAME.format('least(lv, 2)')} ELSE {_NAME.format('lv')} END AS level FROM leveled", **_C),
    "r6_trigger": sql("SELECT scope, n, split_part(d, '|', 1) AS decision, split_part(d, '|', 2) AS reason, split_part(r, '|', 1) AS decision_from_review, split_part(r, '|', 2) AS reason_from_review FROM decided", **_C, decided=_DECIDED),
    "r7_route": sql(f"SELECT scope, period, CASE WHEN k = 1 THEN 'NoAction' WHEN k = {len(DIAGNOSES)} THEN 'RequestMoreEvidence' ELSE 'Route' END AS output, {_ROUTE}[k] AS route, CASE WHEN k BETWEEN 2 AND {len(R.ROUTES) + 1} AND scope / 100 > 0.05::DOUBLE THEN 'World Model Repair' END AS alternative FROM (SELECT scope, CAST(period AS VARCHAR) AS period, (observed + day(period)) % {len(DIAGNOSES)} + 1 AS k FROM gap)"),
    "r8_passed_on": sql("SELECT scope, n, CASE split_part(d, '|', 1) WHEN 'CreateDecisionCase' THEN 'ERROR' ELSE split_part(d, '|', 1) END AS by_decision, CASE lv WHEN 2 THEN 'RequestMoreEvidence' WHEN 1 THEN 'Monitor' ELSE 'NoAction' END AS by_level FROM decided", **_C, decided=_DECIDED),
    "w8_cooldown": sql("SELECT scope, n, split_part(d, '|', 1) AS decision, split_part(d, '|', 2) AS reason FROM fold", **_C, ordered=_ORDERED, fold=_FOLD).replace("WITH ", "WITH RECURSIVE ", 1),
    "w7_persistence": sql("SELECT scope, n, CAST(persistence AS INTEGER) AS persistence FROM pers", **_C),
}
