"""Toxic text by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other training text is unlabelled, toxic or not.
With the class prior p, the mean loss of positives called negative is taken off the
unlabelled loss, and where that estimate of the negative risk falls below zero the step goes against it:

    risk(g) = p R_pos(+) + max(0, R_unl(-) - p R_pos(-)),   loss l(z) = sigmoid(-z)

Features are hashed words (runs of letters, lower-cased) and their first 4 to 7 bytes, so that forms
of one stem share a feature. The ``features`` slots that stand out most
among the positives are kept, as the logarithm of their count in the whole text; slots are counted
and chosen in Spark, so that the driver gets the chosen ones only, at most ``features`` numbers a
document. A linear model over them is fitted there in numpy from at most ``max_positive`` positives
and ``max_unlabelled`` other documents. Scoring is one pass over all whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.llm.learning import Adam, label_sample, remainder, sigmoid
from assetlane.llm.tables import small_batches, store
from assetlane.llm.words import chunks, codes_of, mix, split

PREFIXES = (4, 5, 6, 7)
SLOTS, FEATURES, MAX_POSITIVE, MAX_UNLABELLED, STEPS = 1 << 20, 512, 3000, 9000, 600


def slots(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word and stem slots of each text in order, their counts, and where each text's begin."""
    w = split(texts, fold=True, letters=True)
    size, owner = w.end - w.start, w.doc
    codes, owners = [w.code], [owner]
    for length in PREFIXES:
        at = np.flatnonzero(size > length)
        codes.append(codes_of(w.buf, w.start[at], w.start[at] + length) + np.uint64(length))
        owners.append(owner[at])
    slot = (mix(np.concatenate(codes)) % np.uint64(SLOTS)).astype(np.int64)
    key, count = np.unique(np.concatenate(owners) * SLOTS + slot, return_counts=True)
    return key % SLOTS, count, np.searchsorted(key // SLOTS, np.arange(len(texts) + 1))


class Linear:
    def __init__(self, chosen: np.ndarray, weight: np.ndarray, bias: float):
        self.weight, self.bias = np.zeros(SLOTS, dtype=np.float32), bias
        self.weight[chosen] = weight

    def score(self, texts: list[bytes]) -> np.ndarray:
        slot, count, first = slots(texts)
        part = np.concatenate([[0], np.cumsum(self.weight[slot] * np.log1p(count), dtype=np.float64)])
        return sigmoid(part[first[1:]] - part[first[:-1]] + self.bias)


def document_counts(rows: DataFrame) -> DataFrame:
    """(slot, p, u): in how many positives and other documents of ``rows`` (label, x) each slot is found.

    A task adds up its documents in two tables of fixed size before the shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, SLOTS), dtype=np.int64)
        for batch in batches:
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[label, np.frombuffer(x.as_buffer(), dtype=np.int32)[::2]] += 1
        slot = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(slot), *(pa.array(found[i, slot]) for i in (1, 0))], ["slot", "p", "u"])

    per_task = rows.select("label", "x").mapInArrow(run, "slot bigint, p bigint, u bigint")
    return per_task.groupBy("slot").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def choose(counts: DataFrame, positives: int, others: int, features: int) -> np.ndarray:
    """Slots found in more positives than the unlabelled rate explains, by standard score."""
    rate = (F.col("u") + F.col("p") + 1) / (others + positives + 2)
    z = (F.col("p") - positives * rate) / F.sqrt(positives * rate * (1 - rate) + 1)
    best = counts.withColumn("z", z).orderBy(F.desc("z"), "slot").limit(features)
    return np.array([r["slot"] for r in best.where("z > 2 AND p >= 3").orderBy(F.desc("z"), "slot").collect()], dtype=np.int64)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS,
        decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by full-batch Adam."""
    p = {"w": np.zeros(positive.shape[1]), "b": np.array([-1.0])}
    adam = Adam(p, 0.05)
    for step in range(steps):
        adam.rate = 0.1 * (1 - step / steps) + 0.001
        sp, su = sigmoid(positive @ p["w"] + p["b"]), sigmoid(unlabelled @ p["w"] + p["b"])
        slope_p, slope_u = sp * (1 - sp) / len(sp), su * (1 - su) / len(su)
        negative = su.mean() - prior * sp.mean()
        if negative >= 0:
            on_p, on_u = -2 * prior * slope_p, slope_u
        else:
            on_p, on_u = prior * slope_p, -slope_u
        adam.step({"w": positive.T @ on_p + unlabelled.T @ on_u + decay * p["w"],
                   "b": np.array([on_p.sum() + on_u.sum()])})
    return p["w"], float(p["b"][0])


def chosen_counts(rows: DataFrame, chosen: np.ndarray) -> DataFrame:
    """``rows`` (doc_id, label, x) with x cut to the chosen slots: pairs of their place in ``chosen`` and their count."""
    place = np.full(SLOTS, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(2):
                slot, count = np.frombuffer(x.as_buffer(), dtype=np.int32).reshape(-1, 2).T
                at = place[slot]
                out.append(np.stack([at[at >= 0], count[at >= 0]], axis=1).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["doc_id", "label", "x"])

    return rows.select("doc_id", "label", "x").mapInArrow(run, "doc_id bigint, label int, x binary")


def _dense(rows: list[bytes], features: int) -> np.ndarray:
    out = np.zeros((len(rows), features), dtype=np.float32)
    for i, x in enumerate(rows):
        at, count = np.frombuffer(x, dtype=np.int32).reshape(-1, 2).T
        out[i, at] = np.log1p(count)
    return out


def train(spark: SparkSession, texts: DataFrame, labels: DataFrame, folds: int, held: int, label_col: str = "toxic",
          features: int = FEATURES, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Linear | None:
    """The model, or None where nothing is confirmed toxic."""
    training = remainder("doc_id", folds) != held
    known = labels.where(training & F.col(label_col).isNotNull())
    prior = known.agg(F.avg(F.col(label_col).cast("double"))).first()[0]
    if not prior:
        return None
    positive = label_sample(known.where(F.col(label_col) == 1), label_col, training, max_positive)
    other = (texts.where(training).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id")
             .limit(max_unlabelled).withColumn("label", F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(bodies):
                slot, count, first = slots(bodies[lo:hi])
                pairs = np.stack([slot, count], axis=1).astype(np.int32)
                out = [pairs[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(out, pa.binary())],
                    ["doc_id", "label", "x"])

    # at most max_positive + max_unlabelled rows, so it may be broadcast
    sample = F.broadcast(positive.unionByName(other))
    rows = store(spark, texts.join(sample, "doc_id").select("doc_id", "text", "label")
                 .mapInArrow(run, "doc_id bigint, label int, x binary"), "sample-slots")
    found = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not found.get(0) or not found.get(1):
        return None
    chosen = choose(document_counts(rows), found[1], found[0], features)
    taken = chosen_counts(rows, chosen).toPandas().sort_values(["label", "doc_id", "x"])
    positive, unlabelled = (_dense(list(taken["x"][taken["label"] == label]), len(chosen)) for label in (1, 0))
    return Linear(chosen, *fit(positive, unlabelled, float(prior)))


def toxicity_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0,
                    label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Labels are learned only from ids whose crc32 modulo ``folds`` is not ``held``; nothing but the
    text makes a score. Null and empty texts get the score of no words; null ids are scored and not
    held out; repeated rows get equal scores. Where nothing is confirmed toxic, every score is 0.
    An empty table gives no rows; other columns are not read.
    """
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    model = spark.sparkContext.broadcast(train(spark, texts, labels, folds, held, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(bodies):
                score = np.zeros(hi - lo) if model.value is None else model.value.score(bodies[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(score, pa.float64())], ["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
