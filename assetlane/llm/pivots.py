"""Exact top-k inner products by pivot-table elimination.

For integer vectors, x.y = (|x|^2 + |y|^2 - d(x, y)^2) / 2, and by the triangle inequality
d(x, y) >= max over pivots p of |d(x, p) - d(y, p)|. The distances of every vector to the pivots are
computed once and stored; each query then has an upper bound for every candidate, evaluates
candidates in the order of the bound, and stops when the next bound is below its k-th score.

Candidates and queries are stored in blocks of rows. Every query block meets every candidate block
once, by a join on the block number; a pair keeps k rows a query, and the k best of those are the
result. Query blocks are broadcast only while their counted size is small. Pivots are picked
farthest-first from a bounded sample; they only decide how much is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlane.llm.tables import if_small, store

PIVOTS, SAMPLE, BLOCK, SLICE = 24, 2048, 2048, 128
_BLOCK = "dim int, rows int, row binary, vec binary, v binary, far binary"


def whole_numbers(vectors: DataFrame, scale: float) -> DataFrame:
    """row, vec_id and v = floor(scale * x) of the vectors that take part."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .where(fine).select(
                F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"),
                F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v")))


def pick_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the row farthest from those before it."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
    return sample[chosen]


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (v * v).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * (v @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def blocks(rows: DataFrame, pivots: dict[int, np.ndarray], size: int) -> DataFrame:
    """Vectors of one length packed into blocks, with their table of distances to the pivots."""
    def pack(dim: int, held: list) -> dict:
        v = np.array([h[2] for h in held], dtype=np.float64).reshape(len(held), dim)
        return {"dim": dim, "rows": len(held), "row": np.array([h[0] for h in held], dtype=np.int64).tobytes(),
                "vec": np.array([h[1] for h in held], dtype=np.int64).tobytes(), "v": v.tobytes(),
                "far": distances(v, pivots[dim]).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("dim", pa.int32()), ("rows", pa.int32()), *[(c, pa.binary()) for c in ("row", "vec", "v", "far")]])
        held: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                mine = held.setdefault(len(row[2]), [])
                mine.append(row)
                if len(mine) == size:
                    yield pa.RecordBatch.from_pylist([pack(len(row[2]), mine)], schema)
                    mine.clear()
        for dim, mine in held.items():
            if mine:
                yield pa.RecordBatch.from_pylist([pack(dim, mine)], schema)

    return rows.mapInArrow(run, _BLOCK)


def best_of_block(q: np.ndarray, q_far: np.ndarray, q_row: np.ndarray, c: np.ndarray, c_far: np.ndarray,
                  c_row: np.ndarray, c_vec: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, candidate, score) of the k best candidates of each query in one block."""
    c_square = (c * c).sum(axis=1)
    out = []
    for i in range(len(q)):
        least = np.abs(c_far - q_far[i]).max(axis=1) if c_far.shape[1] else np.zeros(len(c))
        square = float((q[i] * q[i]).sum())
        # distances are rounded; the slack keeps the bound above the true product
        bound = (square + c_square - least * least * (1 - 1e-9)) / 2 + 1
        order = np.argsort(-bound, kind="stable")
        order = order[c_row[order] != q_row[i]]
        found: list[tuple[int, int, int]] = []
        for lo in range(0, len(order), SLICE):
            if len(found) == k and bound[order[lo]] < -found[-1][0]:
                break
            at = order[lo:lo + SLICE]
            score = c[at] @ q[i]
            if len(found) == k:
                near = score >= -found[-1][0]
                at, score = at[near], score[near]
            found = sorted([*found, *((-int(s), int(c_vec[j]), int(j)) for s, j in zip(score, at))])[:k]
        out += [(i, j, -s) for s, _, j in found]
    return out


def top_products(spark: SparkSession, vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0,
                 block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id and score: the k best inner products of every query with all other rows.

    Queries are the rows whose vec_id is divisible by ``every``. Only the query's own row is left
    out, so a row that repeats its id is a candidate, and a repeated query is answered once a row.
    Ties go to the smaller vec_id. Rows without an id and vectors that are null or hold null or
    non-finite numbers take no part; vectors of another length are no candidates. Fewer candidates
    than k are all returned; an empty table gives no rows. Products are exact up to 2 ** 53.
    """
    rows = store(spark, whole_numbers(vectors, scale), "vectors")
    sample = rows.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).toPandas()  # bounded
    dims = [r["d"] for r in rows.select(F.size("v").alias("d")).distinct().collect()]
    by_dim = {d: [x for x in sample["v"] if len(x) == d] for d in dims}
    table = {d: pick_pivots(np.array(by_dim[d], dtype=np.float64).reshape(len(by_dim[d]), d), pivots) for d in dims}
    candidates = store(spark, blocks(rows, table, block), "candidate-blocks")
    asked = store(spark, blocks(rows.where(F.col("vec_id") % every == 0), table, 256)
                  .withColumn("part", F.monotonically_increasing_id()), "query-blocks")
    parts = store(spark, asked.select("dim", "part").groupBy("dim").agg(F.collect_list("part").alias("parts")), "query-parts")
    names = [c.split()[0] for c in _BLOCK.split(", ")][1:]
    pairs = candidates.join(F.broadcast(parts), "dim").withColumn("part", F.explode("parts")).join(
        if_small(asked.select("part", *[F.col(c).alias(f"q_{c}") for c in names]), 256 * 8 * (max(dims, default=1) + pivots + 2)), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def array(batch, name, i, kind=np.float64):
            return np.frombuffer(batch.column(name)[i].as_py(), dtype=kind)

        for batch in batches:
            for i in range(batch.num_rows):
                n, m = batch.column("rows")[i].as_py(), batch.column("q_rows")[i].as_py()
                c_row, c_vec = array(batch, "row", i, np.int64), array(batch, "vec", i, np.int64)
                q_row, q_vec = array(batch, "q_row", i, np.int64), array(batch, "q_vec", i, np.int64)
                best = best_of_block(
                    array(batch, "q_v", i).reshape(m, -1), array(batch, "q_far", i).reshape(m, -1), q_row,
                    array(batch, "v", i).reshape(n, -1), array(batch, "far", i).reshape(n, -1), c_row, c_vec, k)
                if best:
                    a, b, s = (np.array(x, dtype=np.int64) for x in zip(*best))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (q_row[a], q_vec[a], c_row[b], c_vec[b], s)],
                        ["query_row", "query_id", "row", "vec_id", "score"])

    found = pairs.select(*names, *[f"q_{c}" for c in names]).mapInArrow(
        run, "query_row bigint, query_id bigint, row bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
