"""Graphs of grid cells and units: components, floods, borders traced to rings, hulls and compact covers.

Iterations run on tables: each round is written, and only a count reaches the driver.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrane.session import ship, stored


def borders(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): pairs of cells of ``cells`` (keys, unit_id, i, j) that share a border, by the key of the border."""
    border = lambda di, dj: F.struct((F.col("i") * 2 + di).alias("bi"), (F.col("j") * 2 + dj).alias("bj"))
    e = cells.select(*keys, "unit_id", F.explode(F.array(border(1, 0), border(-1, 0), border(0, 1), border(0, -1))).alias("k")).select(*keys, "unit_id", "k.*")
    return e.groupBy(*keys, "bi", "bj").agg(F.min("unit_id").alias("a"), F.max("unit_id").alias("b")).where("a < b").drop("bi", "bj")


def labelled(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, unit_id, label): the smallest unit_id of each node's component. ``nodes``: (keys, unit_id); ``edges``: (keys, a, b).

    Each round takes the smallest label among the neighbours and then the label of that label, so rounds grow with the
    logarithm of the longest path in most graphs.
    """
    both = stored(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    now = stored(nodes.select(*keys, "unit_id", F.col("unit_id").alias("label")).distinct(), "labels")
    while True:
        near = both.join(now.withColumnRenamed("unit_id", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("unit_id")).agg(F.min("label").alias("low"))
        hooked = now.join(near, [*keys, "unit_id"], "left").select(*keys, "unit_id", "label", F.least("label", F.coalesce("low", "label")).alias("new"))
        jump = hooked.select(*keys, F.col("unit_id").alias("new"), F.col("new").alias("far"))
        then = stored(hooked.join(jump, [*keys, "new"], "left").select(*keys, "unit_id", "label", F.least("new", "far").alias("new")), "labels")
        changed = then.where("new < label").limit(1).count()
        now = then.select(*keys, "unit_id", F.col("new").alias("label"))
        if not changed:
            return now


def numbered_components(cells: DataFrame, key: str, blocked: DataFrame | None = None) -> DataFrame:
    """(key, label, size, number): components of each key's cells by shared borders, largest first (of equal ones the smallest
    label). ``blocked``: borders (key, a, b) that don't join. ``cells``: (key, unit_id, i, j)."""
    edges = borders(cells, [key])
    if blocked is not None:
        edges = edges.join(blocked, [key, "a", "b"], "left_anti")
    sizes = labelled(cells, edges, [key]).groupBy(key, "label").agg(F.count("*").alias("size"))
    return sizes.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("size"), "label")))


def piece_name(name: Column, number: Column) -> Column:
    """The first piece keeps its name, the others get -2, -3 and so on."""
    return F.when(number == 1, name).otherwise(F.concat_ws("-", name, number.cast("string")))


def flood(seeds: DataFrame, edges: DataFrame, keys: list[str], hops: int) -> DataFrame:
    """(keys, unit_id, hop): nodes within ``hops`` steps of the ``seeds`` (keys, unit_id) along ``edges`` (keys, a, b), breadth first."""
    both = stored(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    reached = stored(seeds.select(*keys, "unit_id", F.lit(0).alias("hop")).distinct(), "reached")
    front = reached
    for hop in range(1, hops + 1):
        new = front.join(both.withColumnRenamed("a", "unit_id"), [*keys, "unit_id"]).select(*keys, F.col("b").alias("unit_id")).distinct()
        front = stored(new.join(reached, [*keys, "unit_id"], "left_anti").withColumn("hop", F.lit(hop)), "front")
        if not front.limit(1).count():
            break
        reached = stored(reached.unionByName(front), "reached")
    return reached


def flood_windows(windows: DataFrame, key: str, side: int, hops: int | None = None) -> DataFrame:
    """(key, unit_id): cells reached from the seed by shared borders in each of ``windows`` (key, seed, free) of ``side`` x ``side`` cells.

    free: the cells that aren't walls, as numbers row * side + column; a seed that isn't among them reaches nothing. A window is one
    row, so its flood needs no rounds of jobs; a batch of windows is flooded at once in a task.
    ``hops``: the most borders to cross; then a column hop tells how many a cell is away.
    """
    ship(windows.sparkSession)

    def run(batches):
        for batch in batches:
            n, seed = batch.num_rows, batch.column(1).to_numpy(zero_copy_only=False)
            free = np.zeros((n, side + 2, side + 2), bool)  # with a border of walls
            cell = pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False)
            free[pc.list_parent_indices(batch.column(2)).to_numpy(zero_copy_only=False), cell // side + 1, cell % side + 1] = True
            got = np.zeros_like(free)
            got[np.arange(n), seed // side + 1, seed % side + 1] = True
            got, before = got & free, None
            far = np.where(got, 0, -1)
            while (before is None or not np.array_equal(got, before)) and (hops is None or far.max(initial=0) < hops):
                before, got = got, got.copy()
                got[:, 1:] |= before[:, :-1]
                got[:, :-1] |= before[:, 1:]
                got[:, :, 1:] |= before[:, :, :-1]
                got[:, :, :-1] |= before[:, :, 1:]
                got &= free
                far[got & ~before] = far.max(initial=0) + 1
            row, i, j = np.nonzero(got)
            out = [batch.column(0).take(pa.array(row)), pa.array((i - 1) * side + j - 1, pa.int64())]
            out += [] if hops is None else [pa.array(far[row, i, j], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, [key, "unit_id", "hop"][: len(out)])

    kind = windows.schema[key].dataType.simpleString()
    rows = windows.select(key, F.col("seed").cast("long"), F.col("free").cast("array<bigint>"))
    return rows.mapInArrow(run, f"{key} {kind}, unit_id bigint" + ("" if hops is None else ", hop int"))


def filled(cells: DataFrame, key: str, low: tuple[int, int], side: int) -> DataFrame:
    """(key, i, j): each key's ``cells`` (key, i, j) and the cells of their holes: all that the outer ones of the key's ``rings`` hold.

    Cells lie in the square of ``side`` x ``side`` cells from ``low`` on, else it is an error; a cell without a place is left out. What is
    outside is flooded from round the square, across borders and corners, since cells that only meet at a corner don't close a ring.
    A square is one row, so filling needs no rounds of jobs; a batch of squares is flooded at once in a task.
    """
    ship(cells.sparkSession)

    def run(batches):
        for batch in batches:
            n, own = batch.num_rows, pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False)
            free = np.ones((n, side + 2, side + 2), bool)  # with a border that is outside
            free[pc.list_parent_indices(batch.column(1)).to_numpy(zero_copy_only=False), own // side + 1, own % side + 1] = False
            out, before = np.zeros_like(free), None
            out[:, [0, -1]] = out[:, :, [0, -1]] = True
            while before is None or not np.array_equal(out, before):
                before, wide = out, out.copy()
                wide[:, 1:] |= before[:, :-1]
                wide[:, :-1] |= before[:, 1:]
                out = wide.copy()
                out[:, :, 1:] |= wide[:, :, :-1]
                out[:, :, :-1] |= wide[:, :, 1:]
                out &= free
            row, i, j = np.nonzero(~out)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(i - 1 + low[0], pa.int64()), pa.array(j - 1 + low[1], pa.int64())], [key, "i", "j"])

    i, j = F.col("i") - low[0], F.col("j") - low[1]
    at = F.when(i.between(0, side - 1) & j.between(0, side - 1), (i * side + j).cast("long")).otherwise(F.raise_error(F.lit("a cell outside the square")).cast("long"))
    squares = cells.where("i IS NOT NULL AND j IS NOT NULL").groupBy(key).agg(F.collect_set(at).alias("own"))  # side x side numbers at most
    return squares.mapInArrow(run, f"{key} {cells.schema[key].dataType.simpleString()}, i bigint, j bigint")


def border_edges(cells: DataFrame, key: str) -> DataFrame:
    """(key, x1, y1, x2, y2): directed edges round each key's cells (key, i, j), cells on the left, in cell coordinates."""
    side = lambda k, di, dj, *e: F.struct((F.col("i") + di).alias("ni"), (F.col("j") + dj).alias("nj"), *((F.col("i" if n % 2 == 0 else "j") + v).cast("long").alias(c) for n, (c, v) in enumerate(zip(("x1", "y1", "x2", "y2"), e, strict=True))))
    own = cells.select(key, "i", "j").distinct()
    sides = own.select(key, F.explode(F.array(side(0, 0, -1, 0, 0, 1, 0), side(1, 1, 0, 1, 0, 1, 1), side(2, 0, 1, 1, 1, 0, 1), side(3, -1, 0, 0, 1, 0, 0))).alias("s")).select(key, "s.*")
    return sides.join(own.select(key, F.col("i").alias("ni"), F.col("j").alias("nj")), [key, "ni", "nj"], "left_anti").select(key, "x1", "y1", "x2", "y2")


def successors(edges: DataFrame, key: str) -> DataFrame:
    """``edges`` (key, x1, y1, x2, y2) with x3, y3, the end of the edge that follows: where two leave a vertex the one that turns
    left most, so rings don't touch themselves."""
    after = edges.select(key, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"))
    turn = (F.col("x2") - F.col("x1")) * (F.col("y3") - F.col("y2")) - (F.col("y2") - F.col("y1")) * (F.col("x3") - F.col("x2"))
    met = edges.join(after, [key, "x2", "y2"]).groupBy(key, "x1", "y1", "x2", "y2").agg(F.max_by(F.struct("x3", "y3"), turn).alias("n"))
    return met.select(key, "x1", "y1", "x2", "y2", "n.x3", "n.y3")


def _paths(edges: list[tuple[int, ...]]) -> list[tuple[tuple, tuple | None, list[tuple[int, int]]]]:
    """(first edge, edge that follows the last, vertices before each step) of each maximal path of ``edges`` (x1, y1, x2, y2, x3, y3);
    a closed path has nothing that follows."""
    following = {e[:4]: e[2:] for e in edges}
    inner = set(following.values())
    heads = sorted(e for e in following if e not in inner)
    out, seen = [], set()
    for closed, starts in ((False, heads), (True, sorted(following))):
        for first in starts:
            if first in seen:
                continue
            at, path = first, []
            while at in following and at not in seen:
                seen.add(at)
                path.append(at[:2])
                at = following[at]
            out.append((first, None if closed else at, path))
    return out


def _corners(path: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A path's first and last vertex and those at which it turns."""
    turns = [b for a, b, c in zip(path, path[1:], path[2:], strict=False) if (b[0] - a[0], b[1] - a[1]) != (c[0] - b[0], c[1] - b[1])]
    return [path[0], *turns, *path[-1:]] if len(path) > 1 else path


def _far(p: tuple, a: tuple, b: tuple) -> float:
    """Distance of p from the stretch a, b."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    long = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / long)) if long else 0.0
    return ((p[0] - a[0] - t * dx) ** 2 + (p[1] - a[1] - t * dy) ** 2) ** 0.5


def simplified(points: list[tuple], tolerance: float) -> list[tuple]:
    """Douglas-Peucker: the points of an open line that keep it within ``tolerance``."""
    keep, todo = {0, len(points) - 1}, [(0, len(points) - 1)]
    while todo:
        a, b = todo.pop()
        far, at = max(((_far(points[k], points[a], points[b]), -k) for k in range(a + 1, b)), default=(0.0, 0))
        if far > tolerance:
            keep.add(-at)
            todo += [(a, -at), (-at, b)]
    return [points[k] for k in sorted(keep)]


def _by_groups(rows: DataFrame, keys: int, work, schema: str) -> DataFrame:
    """What ``work`` makes of the rows of each group by the first ``keys`` columns, as rows of ``schema``. Groups follow each other in a
    partition's batches, one in memory at a time, so that millions of small ones cost little more than their rows."""
    ship(rows.sparkSession)
    names = [c.split()[0] for c in re.split(r", (?![^<]*>)", schema)]

    def run(batches):
        out = []
        each = itertools.chain.from_iterable(b.itertuples(index=False, name=None) for b in batches)
        for _, own in itertools.groupby(each, key=lambda r: r[:keys]):
            out += work(list(own))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    on = rows.columns[:keys]
    return rows.repartition(*on).sortWithinPartitions(*on).mapInPandas(run, schema)


#: Cells along a side of a tile, in which one task follows border edges.
TILE = 256


def rings(cells: DataFrame, key: str, tolerance: float, tile: int = TILE) -> DataFrame:
    """(key, ring, edges, points, doubled): rings round each key's cells (key, i, j), simplified to within ``tolerance`` cells.

    edges and doubled (twice the signed area in cells; holes are negative) are those of the ring before it is simplified,
    points (x, y) those after it, from its smallest vertex on. Rings are numbered by length, then by their first vertices.

    Every border edge finds the edge that follows it by a join. A task follows the edges of one tile of a key; the paths that
    leave their tile are joined to rings by labels that jump along pointers, so a long border is never followed in one task.
    Lengths and areas are sums over paths; only a ring's corners are gathered, to be simplified.
    """
    ship(cells.sparkSession)
    edges = stored(border_edges(cells, key), "border")
    tiled = successors(edges, key).withColumns({"tx": F.floor(F.col("x1") / tile), "ty": F.floor(F.col("y1") / tile)})
    xy = "array<struct<x:long,y:long>>"

    def follow(own: list[tuple]) -> list[tuple]:
        rows = []
        for first, after, path in _paths([r[3:] for r in own]):
            ends = [*path[1:], path[0] if after is None else after[:2]]
            doubled = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(path, ends, strict=True))
            rows.append((own[0][0], _name(first), _name(after) if after else None, len(path), doubled, [{"x": x, "y": y} for x, y in _corners(path)]))
        return rows

    kind = cells.schema[key].dataType.simpleString()
    tiled = tiled.select(key, "tx", "ty", "x1", "y1", "x2", "y2", "x3", "y3")
    paths = stored(_by_groups(tiled, 3, follow, f"{key} {kind}, unit_id string, after string, edges long, doubled long, corners {xy}"), "paths")
    open_ = paths.where("after IS NOT NULL")
    if open_.limit(1).count():
        label = labelled(open_.select(key, "unit_id"), open_.select(key, F.col("unit_id").alias("a"), F.col("after").alias("b")), [key])
        paths = paths.join(label, [key, "unit_id"], "left")
    else:
        paths = paths.withColumn("label", F.lit(None).cast("string"))

    def join_up(rows: list[tuple]) -> list[tuple]:
        own = {u: (a, [(int(p["x"]), int(p["y"])) for p in c]) for _, _, u, a, c, _, _ in rows}
        at, ring = next(iter(own)), []
        for _ in own:
            after, corners = own[at]
            ring, at = ring + corners, after
        start = ring.index(min(ring))
        ring = ring[start:] + ring[:start]
        (x, y), (nx, ny) = ring[0], ring[1]
        second = (x + (nx > x) - (nx < x), y + (ny > y) - (ny < y))
        (ex, ey), back = ring[-1], ring[0]
        last = (back[0] - (back[0] > ex) + (back[0] < ex), back[1] - (back[1] > ey) + (back[1] < ey))
        turns = _corners([*ring, last] if last != ring[-1] else ring)
        n = sum(r[5] for r in rows)
        kept = simplified(turns, tolerance) if n > 4 else turns
        return [(rows[0][0], n, sum(r[6] for r in rows), [{"x": float(px), "y": float(py)} for px, py in kept], x, y, *second)]

    paths = paths.select(key, F.coalesce("label", "unit_id").alias("label"), "unit_id", "after", "corners", "edges", "doubled")
    made = _by_groups(paths, 2, join_up, f"{key} {kind}, edges int, doubled long, points array<struct<x:double,y:double>>, x long, y long, x2 long, y2 long")
    order = Window.partitionBy(key).orderBy(F.desc("edges"), "x", "y", "x2", "y2")  # a row for each ring
    return made.select(key, F.row_number().over(order).alias("ring"), "edges", "doubled", "points")


def _name(edge: tuple[int, ...]) -> str:
    return ",".join(map(str, edge[:4]))


def _hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Monotone chain, anticlockwise, without points on the hull's edges."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    halves = []
    for order in (points, points[::-1]):
        own: list[tuple[float, float]] = []
        for p in order:
            while len(own) >= 2 and (own[-1][0] - own[-2][0]) * (p[1] - own[-2][1]) <= (own[-1][1] - own[-2][1]) * (p[0] - own[-2][0]):
                own.pop()
            own.append(p)
        halves += own[:-1]
    return halves


def hulls(points: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """(key, pos, x, y): convex hull of each key's ``points`` (key, x, y), on distinct points of 6 digits.

    A key's points are dealt over ``parts`` tasks first; the hull of their hulls is the hull, so a large key isn't gathered.
    """
    ship(points.sparkSession)

    def hull(rows: list[tuple]) -> list[tuple]:
        return [(rows[0][0], n, *p) for n, p in enumerate(_hull([r[-2:] for r in rows]))]

    schema = f"{key} long, pos int, x double, y double"
    dealt = points.select(F.col(key).cast("long").alias(key), F.round("x", 6).cast("double").alias("x"), F.round("y", 6).cast("double").alias("y")).withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    parted = _by_groups(dealt.select(key, "part", "x", "y"), 2, hull, schema)
    return _by_groups(parted.select(key, "x", "y"), 1, hull, schema)


def compact_terms(truth: DataFrame, terms: DataFrame, most: int = 12) -> DataFrame:
    """(dealer_id, n, term, gain): a short description of each dealer's units, greedily: the term of largest (hits less extra
    units, hits, share of hits), as long as that gain is 1 or more. Equal terms go by name.

    ``truth``: (dealer_id, unit_id); ``terms``: (term, unit_id). A term is a candidate of the dealers it touches. Rounds run for
    all dealers at once on a table of candidates' units: a candidate's hits and extra units are counted once and lessened
    by the units that each round covers, so a unit of a candidate is met again only in the round that covers it.
    """
    own = truth.select("dealer_id", "unit_id").distinct()
    every = terms.select("term", "unit_id").distinct()
    touched = own.join(every, "unit_id").select("dealer_id", "term").distinct()
    held = touched.join(every, "term").join(own.withColumn("hit", F.lit(1)), ["dealer_id", "unit_id"], "left")
    held = stored(held.select("dealer_id", "term", "unit_id", F.coalesce("hit", F.lit(0)).alias("hit")), "candidates")
    counts = stored(held.groupBy("dealer_id", "term").agg(F.sum("hit").alias("hits"), F.count("*").alias("size")), "counts")
    covered, out = held.select("dealer_id", "unit_id").limit(0), None
    for n in range(1, most + 1):
        gain = 2 * F.col("hits") - F.col("size")
        worth = F.struct((-gain).alias("g"), (-F.col("hits")).alias("h"), (-F.col("hits") / F.greatest("size", F.lit(1))).alias("s"), F.col("term").alias("t"))
        best = counts.groupBy("dealer_id").agg(F.min_by(F.struct("term", gain.alias("gain"), "hits"), worth).alias("b"))
        best = stored(best.where("b.hits > 0 AND b.gain >= 1").select("dealer_id", F.lit(n).alias("n"), "b.term", "b.gain"), "chosen")
        out = best if out is None else out.unionByName(best)
        if n == most or not best.limit(1).count():
            return out
        new = stored(held.join(best.select("dealer_id", "term"), ["dealer_id", "term"]).select("dealer_id", "unit_id").join(covered, ["dealer_id", "unit_id"], "left_anti"), "covered")
        covered = covered.unionByName(new)
        lost = held.join(new, ["dealer_id", "unit_id"]).groupBy("dealer_id", "term").agg(F.sum("hit").alias("h"), F.count("*").alias("s"))
        left = counts.join(best.select("dealer_id", "term"), ["dealer_id", "term"], "left_anti").join(best.select("dealer_id"), "dealer_id", "left_semi")
        counts = stored(left.join(lost, ["dealer_id", "term"], "left").select("dealer_id", "term", (F.col("hits") - F.coalesce("h", F.lit(0))).alias("hits"), (F.col("size") - F.coalesce("s", F.lit(0))).alias("size")), "counts")
    return out
