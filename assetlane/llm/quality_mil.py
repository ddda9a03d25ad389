"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage of a text is encoded into style counts
and a hashed bag of words, then by a learned layer r = tanh(E x + e). Gated attention

    a_i = softmax_i( w . (tanh(V r_i) * sigmoid(U r_i)) )

weighs the passages, and the weighted representation sum_i a_i r_i gives the score through a
logistic unit. All parameters are learned from document labels in numpy.

The model is fitted on the driver, in minibatches of whole bags, from at most ``max_labels``
labelled documents: in the order of a hash of their ids, until their texts have ``max_bytes``. A
document is taken with all its passages or not at all; the bounds hold for fitting only. Scoring is
one pass over all whole texts, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.llm.learning import Adam, bag_sum, label_sample, remainder, sigmoid
from assetlane.llm.tables import small_batches
from assetlane.llm.words import LETTER, chunks, mix, split

PASSAGE, HASHED, HIDDEN, GATES = 64, 24, 24, 12
MAX_LABELS, MAX_BYTES, EPOCHS = 6000, 64 << 20, 30


def _flags(*chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(b"".join(chars))] = True
    return table


_SYMBOL, _STOP, _COMMA, _BANG = _flags(b"#*$%&|<>"), _flags(b".?"), _flags(b",;:"), _flags(b"!")
_DIGIT, _UPPER = _flags(bytes(range(48, 58))), _flags(bytes(range(65, 91)))
_WIDE = np.arange(256) >= 128


def encode(texts: list[bytes], passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and where the passages of each text begin. No text has none."""
    w = split(texts)
    many = np.diff(w.first)
    bags = np.maximum(1, -(-many // passage))
    first = np.concatenate([[0], np.cumsum(bags)])
    owner = np.repeat(np.arange(len(texts)), bags)
    begin = w.first[owner] + (np.arange(first[-1]) - first[owner]) * passage
    stop = np.minimum(begin + passage, w.first[owner + 1])
    n = np.maximum(stop - begin, 1).astype(np.float64)
    mine = np.repeat(np.arange(first[-1]), stop - begin)

    def per_byte(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[w.buf], dtype=np.int64)])
        return total[w.end] - total[w.start]

    def per_passage(values: np.ndarray) -> np.ndarray:
        return np.bincount(mine, values, minlength=first[-1])

    letters, symbols = per_byte(LETTER), per_byte(_SYMBOL)
    last = w.buf[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    size = w.end - w.start
    doc = w.doc
    same = np.zeros(len(size), dtype=bool)
    same[1:] = (w.code[1:] == w.code[:-1]) & (doc[1:] == doc[:-1])
    salted = w.code ^ mix(mine.astype(np.uint64) + np.uint64(7))
    fresh = np.zeros(len(size), dtype=bool)
    fresh[np.unique(salted, return_index=True)[1]] = True
    again = np.zeros(len(size), dtype=bool)
    if len(size) >= 3:
        three = mix(mix(mix(w.code[:-2] ^ mix(doc[:-2].astype(np.uint64))) + w.code[1:-1]) + w.code[2:])
        inside = np.flatnonzero(doc[:-2] == doc[2:])  # a window never reaches into the next text
        again[inside] = True
        again[inside[np.unique(three[inside], return_index=True)[1]]] = False
    bytes_in = np.maximum(per_passage(size), 1.0)
    share = [
        np.log1p(stop - begin) / 4, bytes_in / n / 10, per_passage(symbols) / n,
        per_passage(letters == 0) / n, per_passage((letters > 0) & (symbols > 0)) / n,
        per_passage(per_byte(_UPPER)) / np.maximum(per_passage(letters), 1), per_passage(fresh) / n,
        per_passage(same) / n, per_passage(again) / n, per_passage(_STOP[last]) / n,
        per_passage(_COMMA[last]) / n, per_passage(_BANG[last]) / n,
        per_passage(per_byte(_DIGIT)) / bytes_in, per_passage(per_byte(_WIDE)) / bytes_in,
        per_passage((letters > 0) & (_UPPER[w.buf[w.start]] if len(size) else fresh)) / n,
    ]
    slot = (w.code % np.uint64(HASHED)).astype(np.int64)
    sign = 1.0 - 2.0 * (w.code >> np.uint64(63)).astype(np.float64)
    hashed = np.bincount(mine * HASHED + slot, sign, minlength=first[-1] * HASHED).reshape(-1, HASHED)
    return np.column_stack([*share, hashed / np.sqrt(n)[:, None]]).astype(np.float32), first


class Attention:
    """The model: standardisation, passage layer, gated attention and logistic unit."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = {
            "E": rng.normal(0, d ** -0.5, (d, HIDDEN)), "e": np.zeros(HIDDEN),
            "V": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATES)),
            "U": rng.normal(0, HIDDEN ** -0.5, (HIDDEN, GATES)),
            "w": rng.normal(0, GATES ** -0.5, GATES), "c": np.zeros(HIDDEN), "b": np.zeros(1)}

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        p = self.p
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        r = np.tanh(x @ p["E"] + p["e"])
        t, u = np.tanh(r @ p["V"]), sigmoid(r @ p["U"])
        e = (t * u) @ p["w"]
        size = np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), size))
        a = e / np.repeat(bag_sum(e, first), size)
        z = bag_sum(a[:, None] * r, first)
        return x, r, t, u, a, z, z @ p["c"] + p["b"][0]

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, decay: float) -> dict:
        p, size = self.p, np.diff(first)
        x, r, t, u, a, z, logit = self.forward(x, first)
        d = (sigmoid(logit) - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], size, axis=0)
        da = (dz * r).sum(axis=1)
        de = a * (da - np.repeat(bag_sum(a * da, first), size))
        dg = de[:, None] * p["w"]
        dt, du = dg * u * (1 - t * t), dg * t * u * (1 - u)
        dr = a[:, None] * dz + dt @ p["V"].T + du @ p["U"].T
        dh = dr * (1 - r * r)
        g = {"E": x.T @ dh, "e": dh.sum(axis=0), "V": r.T @ dt, "U": r.T @ du,
             "w": (t * u).T @ de, "c": z.T @ d, "b": np.array([d.sum()])}
        return {k: v + decay * p[k] * (k not in "eb") for k, v in g.items()}

    def score(self, texts: list[bytes]) -> np.ndarray:
        x, first = encode(texts)
        return sigmoid(self.forward(x, first)[-1])


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Attention | None:
    """The model for bags of passage features, or None without examples of both labels."""
    if len(set(labels.tolist())) < 2:
        return None
    together = np.concatenate(bags)
    model = Attention(together.mean(axis=0), together.std(axis=0) + 1e-3, seed)
    model.p["b"][0] = np.log(labels.mean() / (1 - labels.mean()))
    adam, rng = Adam(model.p, 0.01), np.random.default_rng(seed)
    for epoch in range(epochs):
        adam.rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), 64):
            chosen = order[lo:lo + 64]
            first = np.concatenate([[0], np.cumsum([len(bags[i]) for i in chosen])])
            adam.step(model.gradient(np.concatenate([bags[i] for i in chosen]), first, labels[chosen], 1e-4))
    return model


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))


def whole_rows(docs: DataFrame, sample: DataFrame, max_bytes: int) -> DataFrame:
    """The rows of ``sample`` (doc_id, label), in hash order, until their texts have ``max_bytes``.

    The row that reaches the bound is the last one taken, so no text is cut.
    """
    sizes = (docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label")
             .agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("bigint").alias("size")))
    rows = sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # as many as sample has at most
    before = np.concatenate([[0], np.cumsum([r["size"] for r in rows])])[:-1]
    taken = [(r["doc_id"], r["label"]) for r, b in zip(rows, before) if b < max_bytes]
    return docs.sparkSession.createDataFrame(taken, "doc_id bigint, label int")


def train(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "quality",
          max_labels: int = MAX_LABELS, max_bytes: int = MAX_BYTES) -> Attention | None:
    """Fits the model on a bounded sample of the labels for which ``training`` holds."""
    sample = whole_rows(docs, label_sample(labels, label_col, training, max_labels), max_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                x, first = encode(texts[lo:hi])
                out = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(out, pa.binary())],
                    ["doc_id", "label", "x"])

    # at most max_labels rows, so it may be broadcast; a text makes features of under half its bytes
    rows = (docs.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "label")
            .mapInArrow(run, "doc_id bigint, label int, x binary").toPandas().sort_values(["doc_id", "x"]))
    width = encode([b""])[0].shape[1]
    bags = [np.frombuffer(x, dtype=np.float32).reshape(-1, width) for x in rows["x"]]
    return fit(bags, rows["label"].to_numpy(dtype=float))


def quality_scores(spark: SparkSession, docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1,
                   label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
                   carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, and the columns named in ``carry``.

    Labels are learned only from ids whose crc32 modulo ``folds`` is not ``held``; nothing but the
    text makes a score. Null and empty texts are one passage without words and get its score; null
    ids are scored and not held out; repeated rows get equal scores. Without labels of both kinds
    every score is 0.5. An empty table gives no rows; other columns are not read.
    """
    small_batches(spark)
    texts = _texts(docs, id_col, text_col)
    extra = [c for c in carry or [] if c != "doc_id"]
    model = spark.sparkContext.broadcast(train(texts, labels, remainder("doc_id", folds) != held, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(bodies):
                score = np.full(hi - lo, 0.5) if model.value is None else model.value.score(bodies[lo:hi])
                rest = [batch.column(i).slice(lo, hi - lo) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(score, pa.float64()), *rest],
                    ["doc_id", "score", *extra])

    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).cast("binary").alias("__text"),
                       *[F.col(c) for c in extra])
    carried = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    return rows.mapInArrow(run, "doc_id bigint, score double" + carried).select(
        "doc_id", F.coalesce(remainder("doc_id", folds) == held, F.lit(False)).alias("held_out"),
        "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *extra)
