"""Exact metric range join: vectors of one label whose cosine reaches a threshold.

On unit vectors cosine >= t is Euclidean distance <= r = sqrt(2 - 2t), a metric, so pivots can cut
the space into cells:

* equal vectors of a label are one *class* with a weight, so copies are never compared;
* pivots are picked farthest-first from a bounded sample, as many as its replication makes worth while;
  they decide how much work is done, never what is found. A class nearest to pivot p is *native* in cell p;
* if x is native in p' and y within r of x, the triangle inequality gives d(y, p') <= d(y, p) + 2r and
  d(y, p') <= R(p') + r, with p the pivot nearest to y and R(p') the largest distance of a native from
  p'. In Euclidean space y also lies at most r beyond the plane halfway between p and p'. A class that
  meets all three bounds is replicated to p' as a *guest*;
* so every neighbour of a native is in its cell, and cells are joined independently: natives count
  links to all members of their cell.

A cell is cut into blocks of about ``BLOCK`` rows. Block numbers of a cell are paired first, then the
blocks are fetched by number, so a cell that holds most rows is many joins of two blocks. A pair of
blocks returns a count for each native and one link for each class in it (a spanning forest),
never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.llm.components import components
from assetlane.llm.pivots import pick_pivots
from assetlane.llm.tables import if_small, small_batches, store

BLOCK, SAMPLE, MOST_PIVOTS, ROWS = 2048, 2048, 256, 256
#: what moving a vector costs against one comparison of two
MOVE = 250
#: distances are rounded; bounds are widened by this much, so they never drop a link
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows divided by their length. The largest number goes first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def whole_vector(vectors: DataFrame) -> Column:
    """The vector as an array of double, or of float where it is one already."""
    kind = dict(vectors.dtypes)["embedding"]
    return F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")


def classes_of(vectors: DataFrame) -> DataFrame:
    """One row for each distinct vector of a label that can be compared: cls, label, v, n, low."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fine)
            .where(F.exists("embedding", lambda x: x != 0))
            .groupBy("label", whole_vector(vectors).alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"))
            .select(F.monotonically_increasing_id().alias("cls"), "label", "v", "n", "low"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Parts of a batch whose vectors have one length."""
    sizes = batch.column(at).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(sizes):
        yield int(dim), batch.take(pa.array(np.flatnonzero(sizes == dim)))


def distance_table(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (u @ pivots.T), 0))


def natives(classes: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """+cell and far: the nearest pivot of each class and its distance."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch, 2):
                far = distance_table(unit(matrix(part.column(2), dim)), pivots[dim])
                cell = far.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([dim] * len(cell), pa.int32()), pa.array(cell.astype(np.int32)),
                     pa.array(far[np.arange(len(cell)), cell])], ["cls", "label", "v", "n", "dim", "cell", "far"])

    kind = dict(classes.dtypes)
    return classes.select("cls", "label", "v", "n").mapInArrow(
        run, f"cls bigint, label {kind['label']}, v {kind['v']}, n bigint, dim int, cell int, far double")


def reachable(far: np.ndarray, own: np.ndarray, between: np.ndarray, radius: np.ndarray, r: float) -> np.ndarray:
    """Which cells, besides its ``own``, may hold a neighbour of each row of a distance table."""
    row = np.arange(len(own))
    near = far[row, own][:, None]
    reach = (far <= near + 2 * r + SLACK) & (far <= radius + r + SLACK)
    reach &= far * far - near * near <= 2 * (r + SLACK) * between[own] + SLACK
    reach[row, own] = False
    return reach


def choose_pivots(sample: np.ndarray, meets: float, r: float) -> np.ndarray:
    """The first of the farthest-first pivots, as many as cost least by the sample's replication.

    A vector meets ``meets`` others in one cell; with p cells and c of them reached, c / p of these.
    """
    pivots = pick_pivots(sample, MOST_PIVOTS)
    far, between = distance_table(sample, pivots), distance_table(pivots, pivots)
    best, least = 1, math.inf
    p = 1
    while p <= len(pivots):
        own = far[:, :p].argmin(axis=1)
        radius = np.full(p, -np.inf)
        np.maximum.at(radius, own, far[np.arange(len(own)), own])
        cells = 1 + reachable(far[:, :p], own, between[:p, :p], radius, r).sum(axis=1).mean()
        cost = cells * (MOVE + meets / p)
        if cost < least:
            best, least = p, cost
        p *= 2
    return pivots[:best]


def guests(placed: DataFrame, pivots: dict[int, np.ndarray], radius: dict[int, np.ndarray], r: float) -> DataFrame:
    """The cells other than its own that may hold a neighbour of a class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in by_length(batch, 2):
                p = pivots[dim]
                far = distance_table(unit(matrix(part.column(2), dim)), p)
                reach = reachable(far, part.column(5).to_numpy(), distance_table(p, p), radius[dim], r)
                row, cell = np.nonzero(reach)
                held = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [*held.columns[:5], pa.array(cell.astype(np.int32)), pa.array(far[row, cell])], held.schema.names)

    return placed.mapInArrow(run, placed.schema)


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links between classes a and b: each class and the smallest one it is connected to by them."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = np.minimum(new, new[new])
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def linked(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows of x and y have a cosine of at least ``least``; near the border by the full quotient."""
    got = unit(x) @ unit(y).T
    out = got >= least
    for i, j in zip(*np.nonzero(np.abs(got - least) < 1e-12)):
        p, q = x[i], y[j]
        size = (p @ p) * (q @ q)
        if 0 < size < math.inf:
            out[i, j] = p @ q / math.sqrt(size) >= least
    return out


def blocks_of(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Members of cells in blocks of about ``block`` rows, and the number of blocks of each cell."""
    cell = ["label", "dim", "cell"]
    sizes = store(members.sparkSession, members.groupBy(*cell).agg(F.count(F.lit(1)).alias("size")).select(
        *cell, F.ceil(F.col("size") / block).cast("int").alias("blocks")), "cell-sizes")
    large = if_small(sizes.where("blocks > 1"), 24)
    part = F.pmod(F.xxhash64("cls"), F.coalesce("blocks", F.lit(1))).cast("int")
    held = members.join(large, cell, "left").groupBy(*cell, part.alias("part")).agg(
        F.collect_list(F.struct("cls", "n", "v")).alias("held"))  # about ``block`` of them
    return held, sizes


def join_blocks(pairs: DataFrame, least: float) -> DataFrame:
    """What each pair of blocks says of its classes: links counted for natives, and a class reached."""
    def side(cell: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cls, n, v = cell.values.flatten()
        return cls.to_numpy(), n.to_numpy(), matrix(v, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                x, _, xs = side(batch.column("natives")[i], dim)
                y, weight, ys = side(batch.column("members")[i], dim)
                count, a, b = np.zeros(len(x), dtype=np.int64), [x[:0]], [y[:0]]
                for lo in range(0, len(x), ROWS):
                    found = linked(xs[lo:lo + ROWS], ys, least) & (x[lo:lo + ROWS, None] != y)
                    count[lo:lo + ROWS] = found @ weight
                    p, q = np.nonzero(found)
                    for ends, part in zip((a, b), local_forest(x[lo + p], y[q])):
                        ends.append(part)
                node, root = local_forest(np.concatenate(a), np.concatenate(b))
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[some], node])), pa.array(np.concatenate([count[some], np.zeros(len(node), np.int64)])),
                     pa.array(np.concatenate([x[some], root]))], ["cls", "links", "root"])

    return pairs.select("dim", "natives", "members").mapInArrow(run, "cls bigint, links bigint, root bigint")


def metric_join(spark: SparkSession, vectors: DataFrame, least: float = 0.98, block: int = BLOCK,
                pivots: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row.

    Rows are linked when their labels are equal and the cosine of their vectors, in double precision,
    is at least ``least`` (above 0). ``n_links`` counts the other rows linked directly, rows that repeat an id
    included; ``component_id`` is the smallest vec_id that links reach, and ``kept`` says that it is
    the row's own. Null, zero and non-finite vectors (or elements), vectors of another length and null labels
    link with nothing. A row without an id links with nothing; its component_id is null, and it is
    kept. An empty table gives no rows. Other columns are not looked at.

    ``pivots`` only decides how the work is cut; by default the sample does.
    """
    small_batches(spark)
    r = math.sqrt(max(2 - 2 * least, 0))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding", "label")
    classes = store(spark, classes_of(rows), "vector-classes")
    sizes = classes.groupBy(F.size("v").alias("dim"), "label").agg(F.count(F.lit(1)).cast("double").alias("n")).groupBy(
        "dim").agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("meets")).collect()  # a row a vector length
    table = {}
    for s in sizes:
        picked = classes.where(F.size("v") == s["dim"]).orderBy(F.xxhash64("cls")).limit(SAMPLE).select("v").toArrow()
        sample = unit(matrix(picked["v"].combine_chunks(), s["dim"]))
        table[s["dim"]] = pick_pivots(sample, pivots) if pivots else choose_pivots(sample, s["meets"], r)
    placed = store(spark, natives(classes, table), "vector-cells")
    radius = {d: np.full(len(p), -np.inf) for d, p in table.items()}
    for row in placed.groupBy("dim", "cell").agg(F.max("far").alias("far")).collect():
        radius[row["dim"]][row["cell"]] = row["far"]

    cell = ["label", "dim", "cell"]
    inner, inner_blocks = blocks_of(placed, block)
    inner = store(spark, inner, "native-blocks")
    everyone = store(spark, placed.union(guests(placed, table, radius, r)), "vector-members")
    members, member_blocks = blocks_of(everyone, block)
    members = store(spark, members, "member-blocks")
    numbers = inner_blocks.withColumnRenamed("blocks", "i").join(member_blocks.withColumnRenamed("blocks", "j"), cell).select(
        *cell, F.explode(F.sequence(F.lit(0), F.col("i") - 1)).alias("i"), "j").select(
        *cell, "i", F.explode(F.sequence(F.lit(0), F.col("j") - 1)).alias("j"))
    pairs = numbers.join(inner.withColumnRenamed("part", "i").withColumnRenamed("held", "natives"), [*cell, "i"]).join(
        members.withColumnRenamed("part", "j").withColumnRenamed("held", "members"), [*cell, "j"])
    told = store(spark, join_blocks(pairs, least), "vector-links")

    counts = told.where("links > 0").groupBy("cls").agg(F.sum("links").alias("links"))
    comp = components(spark, told.select(F.col("cls").alias("x"), F.col("root").alias("y")))
    named = classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least_id = named.groupBy("comp").agg(F.min("low").alias("component_id"))
    known = named.join(least_id, "comp").join(counts, "cls", "left").select(
        F.col("label").alias("__label"), F.col("v").alias("__v"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.withColumn("v", F.when(F.col("vec_id").isNotNull(), whole_vector(rows))).join(
        known, (F.col("label") == F.col("__label")) & (F.col("v") == F.col("__v")), "left")
    top = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      top.alias("component_id"), F.coalesce(F.col("vec_id") == top, F.lit(True)).alias("kept"))
