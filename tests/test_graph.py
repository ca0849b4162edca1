"""Rings, covers and long keys against plain loops, with hot keys and small ranges."""

from __future__ import annotations

import random
import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from terrane.operators import containment_index, graph, identity, ownership, scores, spatial  # noqa: E402
from terrane.streaming import jobs  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def walked(cells):
    """Rings round cells, followed edge by edge with a turn to the left first."""
    out = {}
    for i, j in cells:
        for a, b, c, d, near in ((i, j, i + 1, j, (i, j - 1)), (i + 1, j, i + 1, j + 1, (i + 1, j)), (i + 1, j + 1, i, j + 1, (i, j + 1)), (i, j + 1, i, j, (i - 1, j))):
            if near not in cells:
                out.setdefault((a, b), []).append((c, d))
    left, rings = {(v, w) for v, ws in out.items() for w in ws}, []
    while left:
        v, w = min(left)
        ring = []
        while (v, w) in left:
            left.discard((v, w))
            ring.append(v)
            dx, dy = w[0] - v[0], w[1] - v[1]
            v, w = w, max(out[w], key=lambda u: dx * (u[1] - w[1]) - dy * (u[0] - w[0]))  # noqa: B023
        k = ring.index(min(ring))
        rings.append(ring[k:] + ring[:k])
    return rings


@pytest.mark.parametrize(("tile", "tolerance"), [(256, 0.0), (3, 0.0), (5, 1.5), (1, 0.7)])
def test_rings_across_tiles_equal_a_plain_walk(spark, tile, tolerance):
    r = random.Random(tile)
    shapes = {0: {(i, j) for i in range(-9, 9) for j in range(12) if r.random() < 0.6}, 1: {(i, j) for i in range(20) for j in range(20)} - {(i, j) for i in range(4, 9) for j in range(7, 15)}, 2: {(5, 5)}, 3: {(i, i) for i in range(9)}}
    df = spark.createDataFrame([(k, i, j) for k, own in shapes.items() for i, j in own] + [(2, 5, 5)], "dealer_id long, i long, j long")
    got = {}
    for x in graph.rings(df, "dealer_id", tolerance, tile).collect():
        got.setdefault(x.dealer_id, []).append((x.ring, x.edges, x.doubled, [(p.x, p.y) for p in x.points]))
    for k, own in shapes.items():
        want = []
        for n, ring in enumerate(sorted(walked(own), key=lambda v: (-len(v), v)), 1):
            doubled = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True))
            want.append((n, len(ring), doubled, graph.simplified(ring, tolerance) if len(ring) > 4 else ring))
        assert sorted(got[k]) == want
        assert sum(d for _, _, d, _ in want) == 2 * len(own)


def chosen(goal, terms, most):
    covered, rows, left = set(), [], dict(sorted(terms.items()))
    while left and len(rows) < most:
        worth = lambda t: (2 * len((left[t] - covered) & goal) - len(left[t] - covered), len((left[t] - covered) & goal), len((left[t] - covered) & goal) / max(len(left[t] - covered), 1))
        best = max(left, key=worth)
        gain, hit, _ = worth(best)
        if hit == 0 or gain < 1:
            break
        covered |= left.pop(best)
        rows.append((len(rows) + 1, best, gain))
    return rows


def test_covers_in_rounds_equal_a_plain_choice(spark):
    r = random.Random(2)
    terms = {f"t{k:02d}": {r.randrange(120) for _ in range(r.randrange(1, 40))} for k in range(40)} | {"all": set(range(120)), "same": set(range(30)), "sama": set(range(30))}
    goals = {d: {r.randrange(120) for _ in range(r.choice([1, 20, 90]))} for d in range(8)} | {9: set(range(30)), 10: {5000}}
    truth = spark.createDataFrame([(d, u) for d, own in goals.items() for u in own], "dealer_id long, unit_id long")
    df = spark.createDataFrame([(t, u) for t, own in terms.items() for u in own], "term string, unit_id long")
    got = {}
    for x in graph.compact_terms(truth, df, 5).orderBy("dealer_id", "n").collect():
        got.setdefault(x.dealer_id, []).append((x.n, x.term, x.gain))
    assert got == {d: rows for d, own in goals.items() if (rows := chosen(own, terms, 5))}


@pytest.mark.parametrize("rows", [7, 10**6])
def test_one_key_with_all_versions(spark, rows):
    r, day = random.Random(rows), datetime(2024, 1, 1)
    versions = [(1 if r.random() < 0.8 else 2, k, day + timedelta(days=r.randrange(90)), day + timedelta(days=r.randrange(90)), f"s{k}") for k in range(150)]
    asks = [(k, r.choice([1, 1, 1, 2, 3]), day + timedelta(days=r.randrange(-5, 99))) for k in range(120)]
    v = spark.createDataFrame(versions, "c long, version long, valid_from timestamp, recorded timestamp, status string")
    got = {x.ask_id: (x.version, x.status) for x in identity.as_of(v, spark.createDataFrame(asks, "ask_id long, c long, at timestamp"), "c", "status", rows).collect()}
    for k, c, at in asks:
        known = max(((valid, n, s) for key, n, valid, recorded, s in versions if key == c and max(valid, recorded) <= at), default=None)
        assert got[k] == ((known[1], known[2]) if known else (None, None))


@pytest.mark.parametrize("rows", [5, 10**6])
def test_conflicts_of_one_store_with_all_intervals(spark, rows):
    r, day = random.Random(rows), datetime(2024, 1, 1)
    made = []
    for _ in range(200):
        start = day + timedelta(days=r.randrange(2000))
        made.append((1 if r.random() < 0.8 else r.randrange(2, 5), r.randrange(12), start, start + timedelta(days=r.choice([0, 1, 3, 20, 700]))))
    made += [(9, 1, day, day + timedelta(days=2)), (9, 2, day + timedelta(days=2), day + timedelta(days=4)), (9, 3, None, day)]
    df = spark.createDataFrame(made, "store_id long, owner long, start timestamp, end timestamp")
    got = {tuple(x) for x in ownership.exclusive_conflicts(df, rows).collect()}
    real = [m for m in made if m[2] is not None and m[2] < m[3]]
    assert got == {(s, a, b) for s, a, x, y in real for t, b, u, w in real if s == t and a < b and x < w and u < y}
    merged = ownership.merged_intervals(df, ["store_id", "owner"], rows).orderBy("store_id", "owner", "s").collect()
    assert all(a.e < b.s for a, b in zip(merged, merged[1:], strict=False) if (a.store_id, a.owner) == (b.store_id, b.owner))


@pytest.mark.parametrize("rows", [5, 10**6])
def test_length_of_one_long_line(spark, rows):
    r = random.Random(1)
    v = [("a", k * 3, r.randrange(1000), r.randrange(1000)) for k in range(80)] + [("b", 1, 5, 5)]
    got = {(x.name, x.pos): x.along for x in spatial.running_length(spark.createDataFrame(v, "name string, pos long, x long, y long"), ["name"], "pos", rows).collect()}
    total = 0.0
    for (_, pos, x, y), (_, _, px, py) in zip(v[:80], [v[0], *v[:79]], strict=True):
        total += ((x - px) ** 2 + (y - py) ** 2) ** 0.5
        assert abs(got["a", pos] - total) < 1e-6
    assert got["b", 1] == 0.0


def test_medians_take_the_middle_two(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 9, 4, 4)] + [("b", float(v)) for v in (5, 1, 100)] + [("c", 7.0), ("d", None)], "k string, v double")
    assert {r.k: r.median for r in scores.medians(df, "k", "v", 3.0).collect()} == {"a": 4.0, "b": 5.0, "c": 7.0}
    assert {r.k: r.median for r in scores.medians(df.where("k = 'a'").unionByName(df.where("k = 'c'").withColumn("k", F.lit("a"))), "k", "v", 1.0).collect()} == {"a": 4.0}


def test_texts_that_hold_others(spark):
    r = random.Random(4)
    words = ["".join(r.choice("ab路c") for _ in range(r.randrange(1, 9))) for _ in range(150)] + ["", None, "路", "zz", "aa"]
    parts, wholes = words[:90] + words[-5:], words[40:] + ["路" * 50]
    df = lambda rows, name: spark.createDataFrame([(x, k) for k, x in enumerate(rows)], f"{name} string, k int")
    got = [tuple(x) for x in containment_index.contained(df(parts, "p"), df(wholes, "w"), "p", "w").collect()]
    want = {(p, w) for p in parts for w in wholes if p and w and p in w}
    assert len(got) == len(want) and set(got) == want


def test_changelog_folds_its_parts(spark, tmp_path):
    r, rows = random.Random(3), []
    for k in range(14):
        own = [(r.randrange(20), k * 100 + i, r.randrange(5)) for i in range(30)] + ([(1, 5000, 3)] if k == 2 else [])
        rows += own
        spark.createDataFrame(own, "unit_id long, seq long, owner long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("unit_id long, seq long, owner long").parquet(f"{tmp_path}/in")
        got = {tuple(x) for x in jobs.changelog(stream, "c", f"{tmp_path}/base", parts=3).collect()}
        want = {}
        for unit, seq, owner in rows:
            want[unit] = max(want.get(unit, (-1, -1)), (seq, owner))
        assert got == {(u, o, s) for u, (s, o) in want.items()}
    names = sorted(p.name for p in (tmp_path / "base").iterdir() if "=" in p.name)
    assert [n for n in names if n.startswith("state")] == ["state=11", "state=3", "state=7"]
