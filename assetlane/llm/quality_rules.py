"""Quality rules as weak supervision: rules vote or abstain, a label model weighs the votes.

Each document gets counts over its whole text, and each rule turns them into a vote: 1 (good), -1
(bad) or 0 (abstain). Where it votes, rule j is right about good documents with accuracy g[j] and
about bad ones with accuracy b[j]; a rule that knows one fault only has a low b and a high g, so its
bad vote says much and its good vote little. Given the share p of good documents, the posterior
log-odds are

    logit(p) + sum over good votes log(g[j] / (1 - b[j])) + sum over bad votes log((1 - g[j]) / b[j])

and expectation-maximisation finds p, g and b from the votes alone. Votes are counted by pattern in
Spark first; there are at most 3 ** rules patterns whatever the corpus, so the model is fitted on
the driver from a table of bounded size, over all documents. A document is kept when its posterior
is at least ``threshold`` and it passes the base rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.llm.tables import small_batches
from assetlane.llm.words import LETTER, chunks, codes_of, mix, split
from assetlane.session import scratch_folder

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_distinct_words", "n_stops", "n_upper", "n_letters",
    "n_bare_words", "n_mixed_words",
]
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A"):ord("Z") + 1] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?")] = True


def _per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over ``first[d]:first[d + 1]``."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element: how often its value occurs, and whether an equal one comes before it."""
    _, at, back, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    return n[back], np.arange(len(key)) != at[back]


def counts_of(texts: list[bytes]) -> np.ndarray:
    """Counts of each text, one row a text, in the order of ``COUNTS``."""
    w = split(texts)
    doc, n = w.doc, np.diff(w.first)
    salt = mix(np.arange(len(texts), dtype=np.uint64) + np.uint64(1))
    total = np.concatenate([[0], np.cumsum((w.buf & 0xC0) != 0x80, dtype=np.int64)])
    word_chars = _per_doc(total[w.end] - total[w.start], w.first)

    key = w.code ^ salt[doc]
    distinct = _per_doc(~_repeats(key)[1], w.first)
    repeat_words = np.zeros(len(texts), dtype=np.int64)
    if len(key) >= 3:
        three = mix(mix(mix(key[:-2]) + key[1:-1]) + key[2:])
        inside = np.flatnonzero(doc[:-2] == doc[2:])
        again = inside[_repeats(three[inside])[0] >= 2]
        covered = np.zeros(len(key), dtype=bool)
        for step in range(3):
            covered[again + step] = True
        repeat_words = _per_doc(covered, w.first)

    feed = np.flatnonzero(w.buf == 10)
    begin = np.concatenate([[0], feed[:-1] + 1]) if len(feed) else feed
    a, b = np.searchsorted(w.start, begin), np.searchsorted(w.start, feed)
    full = np.flatnonzero(b > a)
    line_doc = np.searchsorted(w.offset, begin[full], side="right") - 1
    again = _repeats(codes_of(w.buf, begin[full], feed[full]) ^ salt[line_doc])[1]
    lines = np.bincount(line_doc, minlength=len(texts))
    dup_lines = np.bincount(line_doc[again], minlength=len(texts))

    byte = w.offset
    letters = np.concatenate([[0], np.cumsum(LETTER[w.buf], dtype=np.int64)])
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[w.buf], dtype=np.int64)])
    bare = letters[w.end] == letters[w.start]
    return np.stack([
        n, word_chars, _per_doc(_SYMBOL[w.buf], byte), dup_lines, repeat_words, lines, distinct,
        _per_doc(_STOP[w.buf[w.end - 1]] if len(w.end) else np.zeros(0), w.first),
        _per_doc(_UPPER[w.buf], byte),
        _per_doc(LETTER[w.buf] & ((w.buf & 0xC0) != 0x80), byte),
        _per_doc(bare, w.first), _per_doc(~bare & (marks[w.end] > marks[w.start]), w.first),
    ], axis=1).astype(np.int64)


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``COUNTS`` of every whole text, in one pass; a null text counts as empty."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                table = counts_of(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(c) for c in table.T)],
                    ["doc_id", *COUNTS])

    schema = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)


def _vote(good: Column, bad: Column, may: Column | None = None) -> Column:
    vote = F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    return vote if may is None else F.when(may, vote).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes over ``COUNTS``. A rule abstains where it has too little to go by."""
    c = {name: F.col(name).cast("double") for name in COUNTS}
    n, lines = c["n_words"], c["n_lines"]
    some, long = n >= 20, n >= 50
    mean = c["word_chars"] / F.greatest(n, F.lit(1.0))
    share = {k: c[k] / F.greatest(n, F.lit(1.0)) for k in COUNTS}
    upper = c["n_upper"] / F.greatest(c["n_letters"], F.lit(1.0))
    return {
        "word_length": _vote(mean.between(3, 9), (mean < 2) | (mean > 14), some),
        "symbols": _vote(share["n_symbols"] <= 0.1, share["n_symbols"] > 0.25, some),
        "mixed_words": _vote(share["n_mixed_words"] <= 0.1, share["n_mixed_words"] > 0.3, some),
        "bare_words": _vote(share["n_bare_words"] <= 0.15, share["n_bare_words"] > 0.3, some),
        "dup_lines": _vote(c["n_dup_lines"] <= 0.1 * lines, c["n_dup_lines"] > 0.4 * lines, lines >= 5),
        "repeats": _vote(share["n_repeat_words"] <= 0.15, share["n_repeat_words"] > 0.4, long),
        "variety": _vote(share["n_distinct_words"] >= 0.35, share["n_distinct_words"] < 0.2,
                         n.between(50, 2000)),
        "stops": _vote(share["n_stops"].between(0.01, 0.3), share["n_stops"] > 0.6, long),
        "upper": _vote(upper <= 0.2, upper > 0.6, c["n_letters"] >= 50),
    }


def fit_accuracies(votes: np.ndarray, weight: np.ndarray, rounds: int = 300,
                   good_prior: float = 0.98, bad_prior: float = 0.4,
                   strength: float = 20.0) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, accuracies on good and on bad ones, by expectation-maximisation.

    ``votes`` has a row for each pattern, ``weight`` its count. Accuracies start at the priors and
    have Beta priors of ``strength`` votes there, so that "good" keeps its meaning; beyond them the data decide, also that a rule condemns good
    documents often. Without votes the start is returned.
    """
    up, down = (votes > 0).astype(float), (votes < 0).astype(float)
    share, good, bad = 0.8, np.full(votes.shape[1], good_prior), np.full(votes.shape[1], bad_prior)
    for _ in range(rounds):
        logit = log_odds(share, good, bad, up, down)
        is_good = weight / (1 + np.exp(-np.clip(logit, -60, 60)))
        is_bad = weight - is_good
        new_good = (is_good @ up + good_prior * strength) / (is_good @ (up + down) + strength)
        new_bad = (is_bad @ down + bad_prior * strength) / (is_bad @ (up + down) + strength)
        new_good, new_bad = np.clip(new_good, 0.02, 0.9999), np.clip(new_bad, 0.02, 0.99)
        new_share = float(np.clip((is_good.sum() + 8) / (weight.sum() + 10), 0.05, 0.95))
        moved = max(abs(new_good - good).max(), abs(new_bad - bad).max(), abs(new_share - share))
        share, good, bad = new_share, new_good, new_bad
        if moved < 1e-9:
            break
    return share, good, bad


def log_odds(share, good, bad, up, down):
    return np.log(share / (1 - share)) + up @ np.log(good / (1 - bad)) + down @ np.log((1 - good) / bad)


def judge(counts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds the votes, ``quality`` (posterior), ``base_failed`` and ``kept`` to a table of counts.

    ``counts`` is read twice, so pass a stored table.
    """
    names = list(rules())
    voted = counts.withColumns({f"vote_{k}": v for k, v in rules().items()})
    columns = [f"vote_{k}" for k in names]
    patterns = voted.groupBy(*columns).count().collect()  # at most 3 ** len(rules) rows
    votes = np.array([[r[c] for c in columns] for r in patterns], dtype=float).reshape(-1, len(names))
    share, good, bad = fit_accuracies(votes, np.array([r["count"] for r in patterns], dtype=float))
    logit = F.lit(float(np.log(share / (1 - share))))
    for c, g, b in zip(columns, good.tolist(), bad.tolist()):
        logit = logit + F.when(F.col(c) > 0, F.lit(float(np.log(g / (1 - b))))).when(
            F.col(c) < 0, F.lit(float(np.log((1 - g) / b)))).otherwise(F.lit(0.0))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = 1 / (1 + F.exp(-logit))
    return voted.withColumns({
        "quality": quality, "base_failed": base, "kept": ~base & (quality >= threshold)})


def quality_rules(spark: SparkSession, docs: DataFrame, threshold: float = 0.5,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts, votes, posterior and verdict of every document.

    Null and empty texts have no words and fail the base rule. Null ids and repeated rows are judged
    like any other row; other columns are not read. An empty table gives no rows. Counts are stored
    in the shared folder once, as they are read for the model and for the verdicts.
    """
    small_batches(spark)
    path = scratch_folder(spark, "quality-counts")
    text_counts(docs, id_col, text_col).write.parquet(path)
    return judge(spark.read.parquet(path), threshold)
