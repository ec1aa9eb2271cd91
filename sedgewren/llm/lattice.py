"""Near-duplicate vectors: E8 lattice hashing with probes of neighbouring cells, then exact cosines.

Each table projects unit vectors at random to eight dimensions and decodes them to the nearest point of the lattice E8: the
vector's cell. Two vectors meet if the cell of one is among those that the other probes, its own and the nearest of the 240
around it, and if their sketches, bits of random signs, differ about as seldom as they should.

Equal vectors are one node. Tight groups of unequal ones are balls: nodes of one cell within half the threshold's angle of
the cell's mean are all linked by the triangle inequality, and count without being compared. Balls (most are single nodes)
meet and are judged as a whole where the inequality allows it; only pairs of balls between are compared node by node, in
blocks. So no row is made for the pairs within a group of copies, and no link is guessed: all follow from cosines.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import materialise, mix
from sedgewren.llm.components import connected_components

#: At a cosine of 0.95 a table finds 71 % of pairs and all tables 99.94 %; at 0.98 it is 97 % and all but one in 10^9.
THRESHOLD, TABLES, PROBES, WIDTH = 0.95, 6, 8, 1.0
#: Bits of a sketch, and standard deviations by which two sketches may differ more than expected (one in 10^9 pairs does).
SKETCH_BITS, DEVIATIONS = 128, 6.0
#: Nodes of a cell from which on a ball is made of it, and nodes of a block that is compared at once.
BALL_LEAST, BLOCK = 32, 1024
#: Angles nearer than this to a bound are not decided by it.
MARGIN = 1e-6
#: Numbers of a batch of vectors that are worked on at once.
_AT_ONCE = 1 << 18


def _shortest() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates of 1 or -1, or all of a half with an even number of minus signs."""
    whole = [[(s if k == i else t if k == j else 0) for k in range(8)] for i, j in itertools.combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    half = [s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half, float)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of an even sum."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, rows of eight: of the whole points or of those moved by a half."""
    whole, half = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _cell_keys(points: np.ndarray, dimension: int, table: int) -> np.ndarray:
    key = np.full(len(points), dimension * 1009 + table + 1, np.uint64)
    for column in np.rint(2 * points).astype(np.int64).T:
        key = mix(key + column.astype(np.uint64))
    return key.view(np.int64)


class Lattice:
    """The projections for vectors of one dimension, the same in every task."""

    def __init__(self, dimension: int, tables: int, probes: int, width: float):
        r = np.random.Generator(np.random.PCG64(dimension))
        self.dimension, self.probes, self.around = dimension, probes, _shortest()
        self.projections = [r.normal(size=(dimension, 8)) / width for _ in range(tables)]
        self.signs = r.normal(size=(dimension, SKETCH_BITS))

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the own cell in each table, and of all cells that are probed, own ones included."""
        own, probed = [], []
        for t, projection in enumerate(self.projections):
            x = unit @ projection
            point = nearest_e8(x)
            # The neighbour in the direction of what decoding has left over is the nearest.
            order = np.argsort(-((x - point) @ self.around.T), axis=1, kind="stable")[:, : self.probes]
            own.append(_cell_keys(point, self.dimension, t))
            probed += [own[-1], *(_cell_keys(point + self.around[order[:, k]], self.dimension, t) for k in range(order.shape[1]))]
        return np.stack(own, axis=1), np.stack(probed, axis=1)

    def sketches(self, unit: np.ndarray) -> np.ndarray:
        return np.packbits(unit @ self.signs > 0, axis=1).view(np.int64)


def unit_rows(column: pa.Array, dimension: int, rows: np.ndarray) -> np.ndarray:
    """Those rows of a list column, all of the dimension, scaled to length one without overflow."""
    at = column.offsets.to_numpy()[rows]
    x = column.values.to_numpy(zero_copy_only=False)[at[:, None] + np.arange(dimension)].astype(float)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _by_dimension(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    lengths = np.diff(column.offsets.to_numpy())
    for dimension in np.unique(lengths):
        rows = np.flatnonzero(lengths == dimension)
        step = max(1, _AT_ONCE // max(int(dimension), 240))
        for i in range(0, len(rows), step):
            yield int(dimension), rows[i : i + step]


_KEYED = "node bigint, own array<bigint>, probe array<bigint>, s1 bigint, s2 bigint"


def _keyed(tables: int, probes: int, width: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices: dict[int, Lattice] = {}
        for batch in batches:
            vec = batch.column("vec")
            for dimension, rows in _by_dimension(vec):
                lattice = lattices.setdefault(dimension, Lattice(dimension, tables, probes, width))
                unit = unit_rows(vec, dimension, rows)
                own, probed = lattice.cells(unit)
                sketch = lattice.sketches(unit)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k.shape[1]), pa.array(k.ravel())) for k in (own, probed)]
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(rows)), *lists, pa.array(sketch[:, 0].copy()), pa.array(sketch[:, 1].copy())], names=["node", "own", "probe", "s1", "s2"])

    return run


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """home, sums: the sum of the unit vectors of each home of a batch."""
    for batch in batches:
        vec, homes = batch.column("vec"), batch.column("home").to_numpy()
        for dimension, rows in _by_dimension(vec):
            found, which = np.unique(homes[rows], return_inverse=True)
            sums = np.zeros((len(found), dimension))
            np.add.at(sums, which, unit_rows(vec, dimension, rows))
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(list(sums), pa.list_(pa.float64()))], names=["home", "sums"])


def _cosines(batch: pa.RecordBatch, a: str, b: str) -> np.ndarray:
    """Row by row; of vectors that differ in dimension, -1."""
    out = np.full(batch.num_rows, -1.0)
    x, y = batch.column(a), batch.column(b)
    same = np.diff(x.offsets.to_numpy()) == np.diff(y.offsets.to_numpy())
    for dimension, rows in _by_dimension(x):
        rows = rows[same[rows]]
        if len(rows):
            out[rows] = (unit_rows(x, dimension, rows) * unit_rows(y, dimension, rows)).sum(axis=1)
    return out


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            angle = np.arccos(np.clip(_cosines(batch, "vec", "center"), -1, 1))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("home"), pa.array(angle)], names=["node", "home", "angle"])


def _judged(threshold: float):
    """a, b and whether all their nodes are linked, for pairs of balls where some may be."""
    limit = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosine = _cosines(batch, "center_a", "center_b")
            angle = np.arccos(np.clip(cosine, -1, 1))
            single = (batch.column("n_a").to_numpy() == 1) & (batch.column("n_b").to_numpy() == 1)
            radii = batch.column("radius_a").to_numpy() + batch.column("radius_b").to_numpy()
            everything = np.where(single, cosine >= threshold, angle + radii <= limit - MARGIN)
            some = np.where(single, everything, angle - radii <= limit + MARGIN)
            keep = pa.array(np.flatnonzero(some))
            columns = [batch.column(c).take(keep) for c in ("a", "b", "weight_a", "weight_b", "n_a", "n_b")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(everything).take(keep)], names=["a", "b", "weight_a", "weight_b", "n_a", "n_b", "whole"])

    return run


def _compared(threshold: float):
    """node, links: what the nodes of one ball's block have of the other's, and the balls if there is any link."""

    def run(key, table):
        a, b = key[0].as_py(), key[1].as_py()
        frame = table.combine_chunks()
        vec = frame.column("vec").combine_chunks()
        vec = vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec
        node, copies, first = (frame.column(c).to_numpy() for c in ("node", "copies", "first"))
        dimension = int(vec.value_lengths()[0].as_py())
        sides = [np.flatnonzero(first), np.flatnonzero(~first)]
        x, y = (unit_rows(vec, dimension, rows) for rows in sides)
        linked = x @ y.T >= threshold
        links = np.concatenate([linked @ copies[sides[1]], linked.T @ copies[sides[0]]]).astype(np.int64)
        at = np.flatnonzero(links)
        return pa.table({"node": node[np.concatenate(sides)][at], "links": links[at], "a": np.full(len(at), a), "b": np.full(len(at), b)})

    return run


def _exploded(members: DataFrame, cells: str) -> DataFrame:
    """ball, radius, s1, s2, key: the cells of each ball, of all its nodes, each once."""
    each = members.select("ball", "radius", "s1", "s2", "n", F.explode(cells).alias("key"))
    # The cells of one node differ already.
    return each.where("n = 1").drop("n").unionByName(each.where("n > 1").drop("n").distinct())


def _valid(vec: Column) -> Column:
    usable = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vec.isNotNull() & usable & F.exists(vec, lambda x: x != 0)


def near_vectors(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, width: float = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of vectors.

    n_links counts the other rows linked with it, copies included: those found whose cosine, in double precision, is the
    threshold or more. component_id is the smallest id among the rows that links tie together, kept whether it is the
    row's own. A pair is found with a probability that grows with its cosine, see TABLES; pairs within a ball, and copies,
    always are. Vectors that are null, empty or zero, or hold a null or a number that is not finite, are alone and link
    with nothing; vectors of different length never link. Ids are of any type that has an order and may repeat or be null
    (a component of null ids only has a null component_id). No rows give no rows; other columns are not looked at.
    """
    rows = vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vec"))
    rows = rows.withColumn("valid", F.coalesce(_valid(F.col("vec")), F.lit(False)))
    usable = rows.where("valid").select("vec_id", "vec")
    nodes = usable.groupBy("vec").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    keyed = materialise(nodes.select("node", "vec").mapInArrow(_keyed(tables, probes, width), _KEYED), "lattice-cells")

    # Balls: of each node the fullest of its own cells, the mean of its nodes, and who is near enough to it.
    own = keyed.select("node", F.explode("own").alias("home"))
    full = materialise(own.groupBy("home").agg(F.count("*").alias("n")).where(F.col("n") >= BALL_LEAST), "full-cells")
    homes = own.join(full, "home").groupBy("node").agg(F.max(F.struct("n", "home"))["home"].alias("home"))
    homes = materialise(homes.join(nodes.select("node", "vec", "copies"), "node"), "homes")
    sums = homes.mapInArrow(_sums, "home bigint, sums array<double>").select("home", F.posexplode("sums").alias("i", "x")).groupBy("home", "i").agg(F.sum("x").alias("x"))
    means = sums.groupBy("home").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("center"))
    means = materialise(means.where(_valid(F.col("center"))), "means")
    angles = homes.join(means, "home").select("node", "home", "vec", "center").mapInArrow(_angles, "node bigint, home bigint, angle double")
    inside = materialise(angles.where(F.col("angle") <= math.acos(threshold) / 2 - MARGIN), "inside")
    balls = inside.join(nodes.select("node", "copies"), "node").groupBy("home").agg(F.min("node").alias("ball"), F.max("angle").alias("radius"), F.sum("copies").alias("weight"), F.count("*").alias("n")).where("n > 1")
    balls = balls.join(means, "home")
    sketches = balls.select(F.col("ball").alias("node"), F.col("center").alias("vec")).mapInArrow(_keyed(tables, probes, width), _KEYED).select(F.col("node").alias("ball"), "s1", "s2")
    balls = materialise(balls.join(sketches, "ball"), "balls")

    tied = inside.select("node", "home").join(balls.select("home", "ball", "radius", "weight", "n", F.col("s1").alias("t1"), F.col("s2").alias("t2")), "home").drop("home")
    members = nodes.join(keyed, "node").join(tied, "node", "left")
    members = materialise(members.select(
        "node", "vec", "copies", "least_id", "own", "probe", F.coalesce("ball", "node").alias("ball"), F.coalesce("radius", F.lit(0.0)).alias("radius"), F.coalesce("weight", "copies").alias("weight"),
        F.coalesce("n", F.lit(1).cast("long")).alias("n"), F.coalesce("t1", "s1").alias("s1"), F.coalesce("t2", "s2").alias("s2"),
    ), "members")

    mine = _exploded(members, "own")
    theirs = _exploded(members, "probe").select("key", F.col("ball").alias("other"), F.col("radius").alias("radius_b"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
    differing = F.bit_count(F.col("s1").bitwiseXOR(F.col("t1"))) + F.bit_count(F.col("s2").bitwiseXOR(F.col("t2")))
    share = F.least(F.lit(1.0), (math.acos(threshold) + F.col("radius") + F.col("radius_b")) / math.pi)
    allowed = SKETCH_BITS * share + DEVIATIONS * F.sqrt(SKETCH_BITS * share * (1 - share))
    met = mine.join(theirs, "key").where((F.col("ball") != F.col("other")) & (differing <= allowed))
    pairs = met.select(F.least("ball", "other").alias("a"), F.greatest("ball", "other").alias("b")).distinct()

    shape = members.where("n = 1").select("ball", "radius", "weight", "n", F.col("vec").alias("center")).unionByName(balls.select("ball", "radius", "weight", "n", "center"))
    side = lambda k: shape.select(*[F.col(c).alias(k if c == "ball" else f"{c}_{k}") for c in shape.columns])
    judged = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_judged(threshold), "a bigint, b bigint, weight_a bigint, weight_b bigint, n_a bigint, n_b bigint, whole boolean")
    judged = materialise(judged, "judged")
    whole = judged.where("whole")
    between = judged.where("NOT whole").select("a", "b", F.ceil(F.col("n_a") / BLOCK).cast("int").alias("blocks_a"), F.ceil(F.col("n_b") / BLOCK).cast("int").alias("blocks_b"))

    def blocks(k: str, o: str) -> DataFrame:
        x = between.join(members.select(F.col("ball").alias(k), "node", "vec", "copies"), k)
        x = x.withColumn(f"block_{k}", F.pmod(F.xxhash64("node"), F.col(f"blocks_{k}")).cast("int")).withColumn(f"block_{o}", F.explode(F.sequence(F.lit(0), F.col(f"blocks_{o}") - 1)))
        return x.select("a", "b", "block_a", "block_b", "node", "vec", "copies", F.lit(k == "a").alias("first"))

    apart = blocks("a", "b").unionByName(blocks("b", "a")).groupBy("a", "b", "block_a", "block_b").applyInArrow(_compared(threshold), "node bigint, links bigint, a bigint, b bigint")
    apart = materialise(apart, "compared")

    of_ball = whole.select(F.col("a").alias("ball"), F.col("weight_b").alias("w")).unionByName(whole.select(F.col("b").alias("ball"), F.col("weight_a").alias("w"))).groupBy("ball").agg(F.sum("w").alias("of_ball"))
    of_node = apart.groupBy("node").agg(F.sum("links").alias("of_node"))
    edges = whole.select("a", "b").unionByName(apart.select("a", "b").distinct())
    roots = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(F.col("node").alias("ball"), "root")
    per_ball = materialise(shape.select("ball").join(of_ball, "ball", "left").join(roots, "ball", "left"), "per-ball")
    each = members.select("node", "vec", "ball", "weight", "least_id").join(per_ball, "ball").join(of_node, "node", "left")
    each = materialise(each.select("vec", "least_id", F.coalesce("root", "ball").alias("root"), (F.col("weight") - 1 + F.coalesce("of_ball", F.lit(0)) + F.coalesce("of_node", F.lit(0))).cast("long").alias("n_links")), "each")
    least = materialise(each.groupBy("root").agg(F.min("least_id").alias("component_id")), "components")
    per_node = materialise(each.join(least, "root").select("vec", "n_links", "component_id"), "per-vector")
    linked = usable.join(per_node, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
