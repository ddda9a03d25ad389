"""Chunks of operators are met in step, and every operator once; long and short streams side by side."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetlane.operators import drawing
from tests.test_documents import random_stream, replay, table


@pytest.mark.parametrize("chunk", [5, 64])
def test_short_and_long_streams_side_by_side(spark, chunk):
    """More streams than are met in step, some of many chunks, operands that are null, not finite or too few."""
    rng = random.Random(chunk)
    streams = {(1 + p % 3, p): random_stream(rng, rng.choice([1, 2, 9, 30, 150])) for p in range(90)}
    for (_, p), ops in streams.items():
        if p % 7 == 0:
            ops += [("cm", [1.0, 0.0, 0.0, None, 0.0, 0.0], None), ("cm", [math.inf] * 6, None), ("cm", None, None), ("Do", None, None), ("Do", None, "Last")]
    want = {}
    for (d, p), ops in streams.items():
        drawn = [(name, m) for name, m in replay(ops) if name]
        if drawn:
            want[d, str(p)] = drawn
    got = {}
    ops = table(spark, streams).withColumn("owner", F.col("page").cast("string")).repartition(5)
    for r in drawing.stream_draws(ops, chunk).orderBy("owner", "op_no").collect():
        got.setdefault((r.doc_id, r.owner), []).append((r.name, tuple(r.m)))
    assert got == want


def test_chunks_in_step_equal_one_by_one():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 40, 60)
    starts, n = np.cumsum(sizes) - sizes, int(sizes.sum())
    codes, operands = rng.choice([0, 1, 2, 2, 3, 4], n), rng.normal(size=(n, 6))
    at, last, left = drawing._in_step(codes, operands, starts, sizes)
    for i, (lo, size) in enumerate(zip(starts, sizes)):
        part = slice(lo, lo + size)
        drawn, _, effect = drawing._one_by_one(codes[part].tolist(), operands[part].tolist(), True)
        assert np.array_equal(at[part][codes[part] == drawing.DRAW].reshape(-1, 6), np.array(drawn).reshape(-1, 6))
        assert tuple(last[i].tolist()) == effect.segs[0] and left.get(i, []) == effect.stack
