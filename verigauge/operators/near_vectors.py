"""Near-identical vectors: an exact angular band join with link counts and classes instead of pairs.

Two vectors link if their cosine is above a threshold, that is if their angle is below theta. Fixed random directions
(anchors) cut the sphere into cells: a vector is at home with the anchor it is closest to. The border between two anchors is
a great circle, so a vector can only have partners in a cell whose border with its own home is
within theta. It visits all these cells, so all partners of a vector visit its home: counts there are whole, without a
pair being seen twice. The number of anchors is fixed, so a vector visits as many cells in a large table as in a small one.

Crowds do not cost pairs. Equal vectors are one node with a count. In a crowded cell some vectors
serve as pivots; what lies within theta / 2 of one becomes a *core*, whose members all link with each other. Cores meet
cells as one ball with a radius: a ball wholly within theta of another links as a whole, one wholly beyond
it not at all, and only the members of balls in between are compared one by one, in blocks.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verigauge.functions import vectors as V
from verigauge.operators.components import components
from verigauge.operators.ranks import stored
from verigauge.operators.sampling import top_per_group
from verigauge.session import ship_package

#: Angles are trusted to so many radians; what is closer to a limit is compared by its cosine.
MARGIN = 1e-6
#: Cells with more nodes get pivots; fewer than so many nodes are no core.
CROWD, LEAST_CORE, PIVOTS = 256, 32, 8
#: Most anchors; vectors of fewer than nine numbers get two to the power of their length.
CELLS = 512
#: Nodes on either side of a block that one task gets, and of a tile of it that is compared at once.
BLOCK, TILE = 8192, 1024


def anchors(dim: int, n: int) -> np.ndarray:
    """The same random unit directions in every task."""
    rows = np.random.default_rng([dim, 20240607]).standard_normal((n, dim))
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _by_dim(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors), for each length of vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        yield rows, matrix(column.take(pa.array(rows)))


def _places(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of unit vectors, the cosines to them, and which is closest."""
    there = anchors(x.shape[1], min(CELLS, 1 << min(x.shape[1], 16)))
    dot = x @ there.T
    return there, dot, dot.argmax(axis=1)


def _homes(batches):
    """Adds the cell each vector is at home in."""
    for batch in batches:
        home = np.zeros(batch.num_rows, np.int64)
        for rows, x in _by_dim(batch.column("v")):
            home[rows] = x.shape[1] * CELLS + _places(x)[2]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home)], [*batch.schema.names, "home"])


def _visits(reach: float) -> Callable:
    """Adds the cell each ball is at home in and all cells it comes within ``reach`` of."""
    def run(batches):
        for batch in batches:
            radius = batch.column("r").to_numpy()
            for rows, x in _by_dim(batch.column("v")):
                there, dot, home = _places(x)
                each = np.arange(len(x))
                chord = np.sqrt(np.maximum(2.0 - 2.0 * there @ there.T, 0.0))
                far = np.sin(np.minimum(reach + radius[rows] + MARGIN, math.pi / 2))
                near = dot[each, home][:, None] - dot <= chord[home] * far[:, None] + MARGIN
                near[each, home] = True
                first = x.shape[1] * CELLS
                cells = pa.ListArray.from_arrays(np.concatenate([[0], near.sum(axis=1).cumsum()]).astype(np.int32), pa.array(first + near.nonzero()[1]))
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows)) for c in batch.columns], pa.array(first + home), cells],
                                                 [*batch.schema.names, "home", "cells"])
    return run


def groups(batches, keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key of sorted batches, one after the other; a group is as large as its caller's blocks are."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], axis=1)
        fresh = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        edges = [0, *fresh.tolist(), batch.num_rows]
        for lo, hi in itertools.pairwise(edges):
            key = tuple(marks[lo])
            if last is not None and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _columns(table: pa.Table, rows: np.ndarray) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    part = table.take(pa.array(rows))
    return (part.column("ball").to_pylist(), part.column("r").to_numpy(), part.column("mass").to_numpy(),
            matrix(part.column("v").combine_chunks()))


def _links(a: list, b: list, linked: np.ndarray, unclear: np.ndarray, mass: np.ndarray) -> list[tuple]:
    """The rows of ``_compare_balls`` for one tile."""
    out = [(a[k], None, n) for k, n in enumerate((linked @ mass).tolist()) if n]
    # one link to each ball, along a tree of those found
    parent = list(range(len(a) + len(b)))

    def root(k, parent=parent):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    first = np.where(linked.any(axis=0), linked.argmax(axis=0), -1)
    for j in np.flatnonzero(first >= 0).tolist():
        parent[root(len(a) + j)] = root(int(first[j]))
        out.append((a[first[j]], b[j], 0))
    # rows that share a partner are joined through it
    for k in np.flatnonzero(linked.any(axis=1)).tolist():
        j = int(linked[k].argmax())
        if root(k) != root(len(a) + j):
            parent[root(k)] = root(len(a) + j)
            out.append((a[k], b[j], 0))
    for k in range(len(a)):
        for j in np.flatnonzero(linked[k]).tolist() if len(set(map(root, np.flatnonzero(linked[k]) + len(a)))) > 1 else ():
            if root(k) != root(len(a) + j):
                parent[root(k)] = root(len(a) + j)
                out.append((a[k], b[j], 0))
    out += [(a[k], b[j], None) for k, j in zip(*np.nonzero(unclear), strict=True)]
    return out


def _compare_balls(cosine: float) -> Callable:
    """Blocks of a cell -> (x, y, n): n linked rows for every member of ball x; a link x - y; or a pair to look into (n null)."""
    theta = math.acos(cosine)

    def run(batches):
        for table in groups(batches, ["cell", "i", "j"]):
            mine = table.column("side").to_numpy(zero_copy_only=False)
            a, ra, _, x = _columns(table, np.flatnonzero(mine == 0))
            b, rb, mass, y = _columns(table, np.flatnonzero(mine == 1))
            if not len(a) or not len(b) or x.shape[1] != y.shape[1]:
                continue
            place = {ball: k for k, ball in enumerate(b)}
            itself = np.array([place.get(ball, -1) for ball in a])
            # no pair of this block with a smaller cosine is linked or unclear
            least = math.cos(min(math.pi, theta + 2 * MARGIN + ra.max() + rb.max()))
            for lo, at in itertools.product(range(0, len(a), TILE), range(0, len(b), TILE)):
                dot = x[lo:lo + TILE] @ y[at:at + TILE].T
                own = np.flatnonzero((itself[lo:lo + TILE] >= at) & (itself[lo:lo + TILE] < at + TILE))
                dot[own, itself[lo + own] - at] = -1.0
                close = dot > least
                rows, cols = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
                if not len(rows):
                    continue
                dot = dot[np.ix_(rows, cols)]
                rows, cols = rows + lo, cols + at
                spread = ra[rows][:, None] + rb[cols][None, :]
                angle = np.arccos(np.clip(dot, -1.0, 1.0))
                linked = np.where(spread > 0, angle + spread < theta - MARGIN, dot > cosine)
                unclear = (spread > 0) & ~linked & (angle - spread <= theta + MARGIN)
                out = _links([a[k] for k in rows], [b[k] for k in cols], linked, unclear, mass[cols])
                if out:
                    part = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(part[0], pa.binary()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.int64())], ["x", "y", "n"])
    return run


def _compare_members(cosine: float) -> Callable:
    """Blocks of two balls' members -> (node, x, y, n): n linked rows of ball y for a node of ball x."""
    def run(batches):
        for table in groups(batches, ["pair", "i", "j"]):
            mine = table.column("side").to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(mine == 0)
            node, _, _, x = _columns(table, rows)
            _, _, mass, y = _columns(table, np.flatnonzero(mine == 1))
            if not len(node) or not len(mass):
                continue
            n = np.concatenate([(x[k:k + TILE] @ y.T > cosine) @ mass for k in range(0, len(x), TILE)])
            hit = np.flatnonzero(n)
            if len(hit):
                head = table.slice(int(rows[0]), 1)
                k = len(hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node[i] for i in hit], pa.binary()), pa.array([head.column("x")[0].as_py()] * k, pa.binary()),
                     pa.array([head.column("y")[0].as_py()] * k, pa.binary()), pa.array(n[hit].astype(np.int64))], ["node", "x", "y", "n"])
    return run


def _assign(held: Broadcast, half: float) -> Callable:
    """(home, node, v) -> (node, pivot, r): the nearest pivot of the cell within ``half``, if any."""
    def run(batches):
        for batch in batches:
            home = batch.column("home").to_numpy()
            for cell in np.intersect1d(home, list(held.value)).tolist():
                rows = np.flatnonzero(home == cell)
                far = np.arccos(np.clip(matrix(batch.column("v").take(pa.array(rows))) @ held.value[cell].T, -1.0, 1.0))
                best = far.argmin(axis=1)
                near = far.min(axis=1)
                hit = np.flatnonzero(near <= half)
                if len(hit):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("node").take(pa.array(rows[hit])), pa.array(list(held.value[cell][best[hit]]), pa.list_(pa.float64())),
                         pa.array(near[hit])], ["node", "pivot", "r"])
    return run


def _key(vector: Column) -> Column:
    return F.unhex(F.md5(vector.cast("string")))


def _cores(nodes: DataFrame, theta: float, crowd: int, least: int) -> DataFrame:
    """(node, ball, v, r) of nodes in cores: the ball they belong to, its pivot, their angle to it."""
    crowded = nodes.groupBy("home").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select("home")
    there = nodes.join(F.broadcast(crowded), "home")
    chosen = top_per_group(there.select("home", "node"), ["home"], [F.xxhash64("node"), F.col("node")], PIVOTS)
    held: dict[int, list] = {}
    # at most PIVOTS vectors for each of the CELLS cells of a length of vectors
    for row in nodes.join(F.broadcast(chosen.select("node")), "node").select("home", "v").collect():
        held.setdefault(row.home, []).append(row.v)
    pivots = nodes.sparkSession.sparkContext.broadcast({home: np.array(v) for home, v in held.items()})
    near = stored(there.select("home", "node", "v").mapInArrow(
        _assign(pivots, theta / 2 - MARGIN), "node binary, pivot array<double>, r double").withColumn("ball", _key(F.col("pivot"))), "cores")
    large = near.groupBy("ball").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("ball")
    return near.join(large, "ball").select("node", "ball", F.col("pivot").alias("v"), "r")


def _blocks(rows: DataFrame, keys: list[str], block: int, payload: list[str], few: bool = False) -> DataFrame:
    """Rows of two sides (``side`` 0, 1) dealt to all blocks (i, j) of their key; a key without both sides has none. The sizes of ``few`` keys are sent to all tasks."""
    size = rows.groupBy(*keys).agg(*[F.ceil(F.sum((F.col("side") == s).cast("int")) / block).alias(f"n{s}") for s in (0, 1)])
    size = size.where("n0 > 0 AND n1 > 0")
    mine = rows.join(F.broadcast(size) if few else size, keys)
    spot = F.xxhash64("ball")
    i = F.when(F.col("side") == 0, F.array(F.pmod(spot, "n0"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n0") - 1))
    j = F.when(F.col("side") == 1, F.array(F.pmod(spot, "n1"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("n1") - 1))
    return (mine.withColumn("i", F.explode(i)).withColumn("j", F.explode(j)).select(*keys, "i", "j", "side", *payload)
            .repartition(*keys, "i", "j").sortWithinPartitions(*keys, "i", "j"))


def near_classes(df: DataFrame, vector: str, item: str, cosine: float = 0.999, crowd: int = CROWD, least_core: int = LEAST_CORE,
                 block: int = BLOCK) -> DataFrame:
    """(item, n_links, class_id) for every row: other rows with a cosine above the threshold, and the smallest item reachable by links.

    Exact: nothing is sampled or cut. Null vectors, empty ones, zeros and those that hold a null, NaN or infinite value link with nothing and
    are classes of their own, as vectors of different lengths never link. Repeated rows and equal vectors
    link with each other. A null item is passed over where the smallest item of a class is looked for.
    """
    spark = df.sparkSession
    ship_package(spark)
    theta = math.acos(cosine)
    raw = V.doubles(F.col(vector))
    fine = (F.size(raw) > 0) & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(raw, lambda x: x != 0)
    rows = df.select(F.col(item).alias("item"), F.when(F.coalesce(fine, F.lit(False)), raw).alias("v"))
    # long or short vectors overflow or vanish when squared
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", F.abs)))
    copies = rows.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("mass"))
    unit = copies.select("v", "mass", scaled.alias("s")).select(_key(F.col("v")).alias("node"), "mass", F.transform(
        "s", lambda x: x / F.sqrt(F.aggregate("s", F.lit(0.0), lambda t, y: t + y * y))).alias("v"))
    nodes = stored(unit.mapInArrow(_homes, "node binary, mass long, v array<double>, home long"), "nodes")
    cores = stored(_cores(nodes, theta, crowd, least_core), "cores")
    inside = nodes.select("node", "mass").join(cores, "node").groupBy("ball").agg(
        F.first("v").alias("v"), F.max("r").alias("r"), F.sum("mass").alias("mass"))
    widest = cores.agg(F.coalesce(F.max("r"), F.lit(0.0))).first()[0]
    single = nodes.join(cores.select("node"), "node", "left_anti")
    balls = single.select(F.col("node").alias("ball"), "v", F.lit(0.0).alias("r"), "mass").unionByName(inside.select("ball", "v", "r", "mass"))
    homes = stored(balls.mapInArrow(
        _visits(theta + widest), "ball binary, v array<double>, r double, mass long, home long, cells array<long>"), "homes")
    visits = homes.withColumn("cell", F.explode("cells"))
    sides = visits.withColumn("side", F.explode(F.when(F.col("cell") == F.col("home"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    found = stored(_blocks(sides, ["cell"], block, ["ball", "r", "mass", "v"], few=True).mapInArrow(
        _compare_balls(cosine), "x binary, y binary, n long"), "found")
    # members of balls that are neither inside nor outside the reach of another
    members = cores.select("node", "ball").join(nodes.select("node", "mass", "v"), "node").unionByName(
        single.select("node", F.col("node").alias("ball"), "mass", "v"))
    unclear = found.where("n IS NULL AND y IS NOT NULL").select("x", "y").distinct().withColumn("pair", F.xxhash64("x", "y"))
    both = unclear.join(members, F.col("x") == F.col("ball")).withColumn("side", F.lit(0)).unionByName(
        unclear.join(members, F.col("y") == F.col("ball")).withColumn("side", F.lit(1)))
    both = stored(both.select("x", "y", "pair", "side", F.col("node").alias("ball"), F.lit(0.0).alias("r"), "mass", "v"), "unclear")
    looked = stored(_blocks(both, ["x", "y", "pair"], block, ["ball", "r", "mass", "v"]).mapInArrow(
        _compare_members(cosine), "node binary, x binary, y binary, n long"), "members")
    links = found.where("n = 0").select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(
        looked.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    parts = components(links)
    by_ball = found.where("n > 0").groupBy("x").agg(F.sum("n").alias("more"))
    by_node = looked.groupBy("node").agg(F.sum("n").alias("few"))
    totals = balls.select("ball", F.col("mass").alias("ball_mass"))
    counted = (members.select("node", "ball").join(totals, "ball").join(by_ball.withColumnRenamed("x", "ball"), "ball", "left")
               .join(by_node, "node", "left").join(parts.withColumnRenamed("node", "ball"), "ball", "left"))
    counted = stored(counted.select(
        "node", (F.col("ball_mass") - 1 + F.coalesce("more", F.lit(0)) + F.coalesce("few", F.lit(0))).alias("n_links"),
        F.coalesce("component", "ball").alias("part")), "counted")
    named = rows.where("v IS NOT NULL").select("item", _key(F.col("v")).alias("node")).join(counted, "node")
    least = named.groupBy("part").agg(F.min("item").alias("class_id"))
    alone = rows.where("v IS NULL").select("item", F.lit(0).cast("long").alias("n_links"), F.col("item").alias("class_id"))
    return named.join(least, "part").select("item", "n_links", "class_id").unionByName(alone)
