"""Gap rules by value: levels, triggers and routes; scans of long scopes against a plain loop; the streaming state machine."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrane.operators import ownership, rules, scans  # noqa: E402
from terrane.streaming import jobs  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def levels(spark, *changes):
    base = {"gap_value": 40.0, "reference": 100.0, "severity": 0.6, "persistence": 4, "strategic": 0.0, "confidence": 0.9, "value": None}
    df = spark.createDataFrame([tuple((base | c).values()) for c in changes], "gap_value double, reference double, severity double, persistence int, strategic double, confidence double, value double")
    return [(r.level, r.caps) for r in rules.materiality(df).collect()]


def test_levels(spark):
    assert [name for name, _ in rules.LEVELS] == ["Informational", "Monitor", "Review", "Actionable", "Critical"]
    got = levels(spark, {}, {"confidence": 0.49}, {"value": -1.0}, {"gap_value": 0.5, "severity": 0.0, "persistence": 1}, {"gap_value": -200.0, "severity": 1.0, "strategic": 1.0}, {"confidence": 0.1, "value": 0.0, "severity": 0.1, "persistence": 1})
    assert got == [("Actionable", []), ("Review", ["confidence_floor"]), ("Review", ["edv_nonpositive"]), ("Informational", []), ("Critical", []), ("Monitor", ["confidence_floor", "edv_nonpositive"])]


def test_identity_problems_cap_levels(spark):
    rows = [(1, "Critical", k == 0) for k in range(10)] + [(2, "Critical", k == 0) for k in range(100)] + [(1, "Monitor", False)]
    got = rules.identity_capped(spark.createDataFrame(rows, "scope int, level string, identity_problem boolean")).select("scope", "level").distinct().collect()
    assert {tuple(r) for r in got} == {(1, "Review"), (1, "Monitor"), (2, "Critical")}


#: (gap, level, periods in a row, confidence, cooldown left, gate) and what a trigger of entry 0.30 and persistence 3 says.
CASES = [
    ((0.4, "Actionable", 3, 0.9, 0, "Actionable"), ("CreateDecisionCase", "entry")),
    ((0.4, "Actionable", 3, 0.9, 2, "Actionable"), ("NoAction", "cooldown")),
    ((0.4, "Critical", 3, 0.9, 2, "Actionable"), ("CreateDecisionCase", "entry")),
    ((0.4, "Review", 3, 0.9, 0, "Actionable"), ("RequestMoreEvidence", "materiality")),
    ((0.4, "Monitor", 3, 0.9, 0, "Actionable"), ("Monitor", "materiality")),
    ((0.4, "Informational", 3, 0.9, 0, "Actionable"), ("NoAction", "materiality")),
    ((0.4, "Actionable", 3, 0.4, 0, "Actionable"), ("RequestMoreEvidence", "confidence")),
    ((0.18, "Actionable", 1, 0.9, 0, "Actionable"), ("Monitor", "persistence")),
    ((0.18, "Actionable", 3, 0.9, 0, "Actionable"), ("Monitor", "band")),
    ((0.10, "Actionable", 5, 0.9, 0, "Actionable"), ("NoAction", "exit")),
    ((0.15, "Actionable", 5, 0.9, 2, "Actionable"), ("NoAction", "exit")),
    ((0.5, "Review", 5, 0.9, 0, "Review"), ("CreateDecisionCase", "entry")),
]


def test_triggers_decide_in_order(spark):
    rows = [x for x, _ in CASES]
    df = spark.createDataFrame(rows, "gap double, level string, persistence int, confidence double, left int, gate string")
    p = {"exit": F.lit(0.15), "entry": F.lit(0.30), "cooldown_left": F.col("left"), "level": F.col("level"), "gate": F.col("gate"), "confidence": F.col("confidence"), "confidence_gate": F.lit(0.6), "persistence": F.col("persistence"), "min_persistence": F.lit(3)}
    got = df.select(rules.decide(F.col("gap"), p).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in got] == [want for _, want in CASES]
    for (gap, level, run, confidence, left, gate), want in CASES:
        t = rules.Trigger(0.30, None, 3, 5, gate=gate)
        assert t.exit == 0.15
        before = run - 1 if gap > 0.15 else run
        assert t.step(t.state(min(before, 3), left), gap, level, confidence)[1:] == want
    for bad in ({"exit_": 0.4}, {"confidence_gate": 1.1}):
        with pytest.raises(ValueError):
            rules.Trigger(0.3, **bad)


def test_routes_of_decisions_and_levels(spark):
    df = spark.createDataFrame([("Monitor", "Review"), ("RequestMoreEvidence", "Monitor"), ("NoAction", "Informational"), ("CreateDecisionCase", "Critical")], "d string, l string")
    got = df.select(rules.route_of_decision(F.col("d")), rules.route_of_level(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("Monitor", "RequestMoreEvidence"), ("RequestMoreEvidence", "Monitor"), ("NoAction", "NoAction"), ("ERROR", "NoAction")]


def periods(seed, scopes, n, missing=0.1):
    r = np.random.default_rng(seed)
    names = [name for name, _ in rules.LEVELS]
    for s in range(scopes):
        for k in range(-5, n):
            if r.random() > missing:
                yield s, k, float(r.choice([0.1, 0.15, 0.2, 0.3, 0.6])), str(r.choice(names, p=[0.05, 0.05, 0.1, 0.7, 0.1])), float(r.choice([0.5, 0.9, 0.95, 1.0]))


def plain_fold(rows, entry, exit_, least, cooldown, gate, idle=None):
    """Decisions of one scope's rows in order, with the case's period remembered."""
    rank = {name: k for k, (name, _) in enumerate(rules.LEVELS)}
    run, until, last, out = 0, None, None, []
    for n, gap, level, confidence in rows:
        if idle is not None and last is not None and n - last - 1 >= idle:
            run, until = 0, None
        run, last = run + 1 if gap > exit_ else 0, n
        if gap <= exit_:
            d = "NoAction"
        elif until is not None and n <= until and level != "Critical":
            d = "NoAction"
        elif rank[level] < 3:
            d = {"Review": "RequestMoreEvidence", "Monitor": "Monitor"}.get(level, "NoAction")
        elif confidence < gate:
            d = "RequestMoreEvidence"
        elif run < least or gap < entry:
            d = "Monitor"
        else:
            d, until = "CreateDecisionCase", n + cooldown
        out.append((n, d))
    return out


@pytest.mark.parametrize(("span", "least", "cooldown", "idle"), [(4096, 2, 3, None), (7, 2, 3, None), (5, 4, 11, 3), (3, 0, 0, 2)])
def test_fold_of_ranges_equals_a_plain_loop(spark, span, least, cooldown, idle):
    rows = list(periods(span, 4, 300))
    df = spark.createDataFrame(rows, "scope long, n long, gap double, level string, confidence double").repartition(3)
    got = rules.fold_cooldown(df, rules.Trigger(0.3, 0.15, least, cooldown, 0.6, idle=idle), span).collect()
    want = {(s, *x) for s in range(4) for x in plain_fold([r[1:] for r in rows if r[0] == s], 0.3, 0.15, least, cooldown, 0.6, idle)}
    assert len(got) == len(rows) and {(r.scope, r.n, r.decision) for r in got} == want


def test_fold_of_one_scope_of_many_periods(spark):
    df = spark.range(300_000).selectExpr("1L as scope", "id as n", "(id * 7919 % 100) / 100 as gap", "CASE WHEN id % 11 = 0 THEN 'Critical' WHEN id % 5 = 0 THEN 'Review' ELSE 'Actionable' END as level", "CASE WHEN id % 13 = 0 THEN 0.1D ELSE 0.9D END as confidence").withColumn("gap", F.col("gap").cast("double"))
    got = rules.fold_cooldown(df, rules.Trigger(0.3, 0.15, 2, 5), 4096).select("n", "decision").orderBy("n").toPandas()
    rows = [(k, k * 7919 % 100 / 100, "Critical" if k % 11 == 0 else "Review" if k % 5 == 0 else "Actionable", 0.1 if k % 13 == 0 else 0.9) for k in range(300_000)]
    assert list(zip(got.n, got.decision, strict=True)) == plain_fold(rows, 0.3, 0.15, 2, 5, 0.6)


@pytest.mark.parametrize("span", [4096, 4, 1])
def test_persistence_across_ranges(spark, span):
    r = np.random.default_rng(span)
    rows = [(s, k, bool(r.random() < 0.8)) for s in range(3) for k in range(200) if r.random() < 0.95] + [(9, k, True) for k in range(100)]
    got = {(x.scope, x.n): x.persistence for x in rules.persistence(spark.createDataFrame(rows, "scope int, n int, breach boolean"), span).collect()}
    seen, want = {(s, k): b for s, k, b in rows}, {}
    for s, k, b in sorted(rows):
        want[s, k] = want.get((s, k - 1), 0) + 1 if b and seen.get((s, k - 1)) else int(b)
    assert got == want


@pytest.mark.parametrize("rows", [10, 10**6])
def test_running_values_of_a_hot_key(spark, rows):
    r = np.random.default_rng(2)
    data = [(int(k), None if r.random() < 0.1 else int(t), float(r.integers(0, 9)) if r.random() < 0.8 else None) for k, t in zip(np.where(r.random(400) < 0.7, 1, r.integers(2, 6, 400)), r.permutation(400), strict=True)]
    df = spark.createDataFrame(data, "k int, t int, v double").where("t is not null or k = 1")
    cuts = scans.ranges(df, "t", rows)
    assert (len(cuts) > 5) == (rows == 10)
    got = scans.running(df.withColumn("span", scans.range_of(F.col("t"), cuts)), ["k"], [F.asc_nulls_first("t"), "v"], "span", {"total": ("sum", F.col("v"), True), "most": ("max", F.col("v"), False), "least": ("min", F.col("v"), True)}).collect()
    by = {}
    for k, t, v in sorted((x for x in data if x[1] is not None or x[0] == 1), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] is not None, x[2] or 0)):
        by.setdefault(k, []).append((t, v))
    want = {}
    for k, own in by.items():
        for i, (t, v) in enumerate(own):
            before, upto = [x for _, x in own[:i] if x is not None], [x for _, x in own[: i + 1] if x is not None]
            want.setdefault((k, t), []).append((sum(upto) if upto else None, max(before, default=None), min(upto, default=None)))
    have = {}
    for x in got:
        have.setdefault((x.k, x.t), []).append((x.total, x.most, x.least))
    order = lambda v: sorted(v, key=str)
    assert {k: order(v) for k, v in have.items() if k[1] is not None} == {k: order(v) for k, v in want.items() if k[1] is not None}


def test_streamed_states_equal_the_batch_fold_and_idle_ones_go(spark, tmp_path):
    trigger = rules.Trigger(0.3, 0.15, 2, 3, 0.6, idle=10)
    rows = [r for r in periods(5, 3, 120) if r[0] != 2 or r[1] < 20]
    df = spark.createDataFrame(rows, "scope long, n long, gap double, level string, confidence double").withColumn("at", F.timestamp_seconds((F.col("n") + 19_723) * 86_400)).cache()
    path, base = f"{tmp_path}/in", f"{tmp_path}/run"
    for k in range(6):
        df.where(F.expr(f"n >= {k * 20 - 5} and n < {k * 20 + 15}")).write.mode("append").parquet(path)
        out = jobs.drain(jobs.triggered(spark.readStream.schema(df.schema).parquet(path), trigger), "x", rocks=True, base=base)  # a new start each time
        time.sleep(0.01)
    got = {tuple(r) for r in out.collect()}
    want = {tuple(r) for r in rules.fold_cooldown(df.where("n < 115"), trigger, 7).collect()}
    assert got == want and len(got) > 200
    state = spark.read.format("statestore").option("stateVarName", "kept").load(f"{base}/log")
    assert {r.key.scope if hasattr(r.key, "scope") else r.key[0] for r in state.collect()} == {0, 1}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rules_with_any_set_of_dimensions_equal_a_plain_search(spark, seed):
    r = np.random.default_rng(seed)
    some = lambda n: None if r.random() < (0.7 if seed == 2 else 0.4) else int(r.integers(0, n))
    nodes = [(k, some(3), some(4), None if (c := some(2)) is None else "ab"[c], int(r.integers(0, 9))) for k in range(0 if seed == 3 else 40)]
    nodes += [(None, 0, 0, "a", 5)] if seed == 3 else []
    stores = [(k, some(3), some(4), None if (c := some(2)) is None else "ab"[c]) for k in range(60)]
    fields = "province long, city long, channel string"
    got = ownership.rule_assign(spark.createDataFrame(stores, f"store_id long, {fields}"), spark.createDataFrame(nodes, f"node_id long, {fields}, dealer_id long"), ownership.DIMS).collect()
    assert len(got) == 60
    for x in got:
        own = stores[x.store_id][1:]
        fits = [(sum(v is not None for v in n[1:4]), n[0] if n[0] is not None else -1, n[4]) for n in nodes if all(v is None or v == o for v, o in zip(n[1:4], own, strict=True))]
        best = max(fits, default=None)
        assert (x.dealer_id, x.cause) == ((best[2], "RULE") if best else (None, "UNASSIGNED"))
