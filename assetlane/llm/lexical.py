"""Ranked lexical search: every document scored against every item by dense blocked products.

Scores are sums over an item's terms of an integer weight times an integer impact, so they can be
computed by BLAS in float64 without rounding as long as every partial sum stays below 2 ** 53:

* the items of a group are cut into *tiles* of some items and the compact vocabulary they use; a
  tile is a dense matrix of weights (terms x items). A tile ends before the weights of any of its
  items could add up to 2 ** 53 with the largest impact, and a heavier weight is split over tiles;
* documents are kept as blocks of (document, term of the vocabulary, frequency). For each tile a
  block becomes a dense matrix of impacts (documents x terms); the product of both is exact, and the
  products of the tiles of one item are added as 64-bit integers;
* of each product only scores that reach the k-th best so far go on, ties included, and the k best
  are chosen by (score, doc_id), so that no tie is decided by the order of blocks.

Terms are compared by 64-bit hashes of their bytes. Items come to the driver as a stream and are
worked on in groups of at most ``GROUP_TERMS`` terms (a longer item stands alone); that bounds what
the tasks are sent. Each group passes over the documents once, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlane.llm.tables import small_batches, store
from assetlane.llm.words import FOLD, chunks, codes_of

GROUP_TERMS = 1 << 19
#: items and terms of a tile, documents of a product, documents and entries of a stored block
TILE_ITEMS, TILE_TERMS, ROWS, BLOCK_ROWS, BLOCK_ENTRIES = 256, 4096, 256, 1024, 1 << 20
EXACT, TOP_IMPACT = 1 << 53, 1_000_000

_TERM = np.zeros(256, dtype=bool)
_TERM[ord("0"):ord("9") + 1] = _TERM[ord("A"):ord("Z") + 1] = _TERM[ord("a"):ord("z") + 1] = True
_TERM[128:] = True
_BLOCK = "rows int, with_terms bigint, terms bigint, doc binary, n binary, entries binary, term binary, tf binary"


def term_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of all texts, A-Z lower-cased, and the first term of each text (and the end)."""
    buf = FOLD[np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", dtype=np.uint8)]
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = _TERM[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return codes_of(buf, start, end), np.searchsorted(start, offset)


@dataclass
class Group:
    """Items of one pass: sorted term hashes, and (item, term, repeats) entries in the order of items."""

    ids: list[int]
    vocabulary: np.ndarray
    item: np.ndarray
    term: np.ndarray
    repeats: np.ndarray


def item_groups(items: DataFrame, limit: int) -> Iterator[Group]:
    """Groups of items with at most ``limit`` distinct terms each, counted per item."""
    def group(ids, found):
        item = np.repeat(np.arange(len(ids)), [len(c) for c, _ in found])
        codes = np.concatenate([c for c, _ in found]) if found else np.empty(0, np.uint64)
        vocabulary, term = np.unique(codes, return_inverse=True)
        return Group(ids, vocabulary, item, term, np.concatenate([n for _, n in found]))

    ids, found, size = [], [], 0
    for row in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").toLocalIterator():
        codes, _ = term_codes([row["text"].encode()])
        if not len(codes):
            continue
        entry = np.unique(codes, return_counts=True)
        if ids and size + len(entry[0]) > limit:
            yield group(ids, found)
            ids, found, size = [], [], 0
        ids.append(row["item_id"])
        found.append(entry)
        size += len(entry[0])
    if ids:
        yield group(ids, found)


def term_blocks(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Blocks of documents: their numbers of terms, and how often each term of the vocabulary occurs."""
    def block(parts: list) -> pa.RecordBatch:
        doc, n, entries, term, tf = (np.concatenate(x) for x in zip(*parts))
        row = [len(doc), int((n > 0).sum()), int(n.sum()), *(x.tobytes() for x in (doc, n, entries, term, tf))]
        kinds = [pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)],
                                          [c.split()[0] for c in _BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows, size = [], 0, 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                codes, first = term_codes(texts[lo:hi])
                n = np.diff(first)
                doc = np.repeat(np.arange(hi - lo), n)
                at = np.searchsorted(vocabulary, codes)
                at[at == len(vocabulary)] = 0
                known = vocabulary[at] == codes
                key, tf = np.unique(doc[known] * len(vocabulary) + at[known], return_counts=True)
                owner, term = key // len(vocabulary), key % len(vocabulary)
                for a in range(0, hi - lo, BLOCK_ROWS):
                    b = min(a + BLOCK_ROWS, hi - lo)
                    x, y = np.searchsorted(owner, [a, b])
                    if parts and (rows + b - a > BLOCK_ROWS or size + y - x > BLOCK_ENTRIES):
                        yield block(parts)
                        parts, rows, size = [], 0, 0
                    parts.append((ids[lo + a:lo + b], n[a:b].astype(np.int64), np.bincount(owner[x:y] - a, minlength=b - a),
                                  term[x:y].astype(np.int32), tf[x:y]))
                    rows, size = rows + b - a, size + y - x
        if parts:
            yield block(parts)

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _BLOCK)


def document_counts(spark: SparkSession, blocks: DataFrame, terms: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary (at most ``GROUP_TERMS`` or one item's numbers)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            for cell in batch.column(0):
                total += np.bincount(np.frombuffer(cell.as_py(), dtype=np.int32), minlength=terms)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "n"])

    counts = blocks.select("term").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(terms, dtype=np.int64)
    out[counts["term"].to_numpy(dtype=np.int64)] = counts["n"]
    return out


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 75 + (75 * n * n_docs) div n_terms, in exact integers."""
    if len(n) and 75 * int(n.max()) * n_docs >= 1 << 63:
        n = n.astype(object)
    return (25 + 75 * n * n_docs // max(n_terms, 1)).astype(np.int64)


@dataclass
class Tile:
    items: slice
    terms: np.ndarray     # of the vocabulary
    weights: np.ndarray   # terms x items, whole numbers as float64


def weight_tiles(group: Group, weight: np.ndarray) -> list[list[Tile]]:
    """For each run of ``TILE_ITEMS`` items its tiles, whose products are exact and add up to the score."""
    most = (EXACT - 1) // TOP_IMPACT
    out = []
    for lo in range(0, len(group.ids), TILE_ITEMS):
        hi = min(lo + TILE_ITEMS, len(group.ids))
        a, b = np.searchsorted(group.item, [lo, hi])
        item, term = group.item[a:b] - lo, group.term[a:b]
        value = group.repeats[a:b] * weight[term]
        tiles = []
        while (value > 0).any():
            now, peak = np.minimum(value, most), {}
            for t, v in zip(term.tolist(), now.tolist()):
                peak[t] = max(peak.get(t, 0), v)
            order = sorted(t for t, v in peak.items() if v)
            ends, total = [], 0
            for i, t in enumerate(order):
                if i - (ends[-1] if ends else 0) == TILE_TERMS or total + peak[t] > most:
                    ends.append(i)
                    total = 0
                total += peak[t]
            for x, y in zip([0, *ends], [*ends, len(order)]):
                terms = np.array(order[x:y])
                inside = (term >= terms[0]) & (term <= terms[-1]) & (now > 0)
                dense = np.zeros((len(terms), hi - lo))
                dense[np.searchsorted(terms, term[inside]), item[inside]] = now[inside]
                tiles.append(Tile(slice(lo, hi), terms, dense))
            value = value - now
        out.append(tiles)
    return out


class Best:
    """The k best (score, document) of every item; equal scores go to the smaller document."""

    def __init__(self, items: int, k: int):
        self.k, self.score, self.doc = k, np.zeros((items, k), dtype=np.int64), np.zeros((items, k), dtype=np.int64)

    def add(self, scores: np.ndarray, doc: np.ndarray, items: slice) -> None:
        """``scores`` of documents (rows) against items (columns); unset places have score 0."""
        floor = np.maximum(self.score[items, -1], 1)
        d, i = np.nonzero(scores >= floor)
        if not len(d):
            return
        touched, at = np.unique(i, return_inverse=True)
        old = touched + items.start
        owner = np.concatenate([at, np.repeat(np.arange(len(touched)), self.k)])
        score = np.concatenate([scores[d, i], self.score[old].ravel()])
        name = np.concatenate([doc[d], self.doc[old].ravel()])
        order = np.lexsort((name, -score, owner))
        owner = owner[order]
        place = np.arange(len(owner)) - np.searchsorted(owner, np.arange(len(touched)))[owner]
        keep = order[place < self.k]
        self.score[old] = score[keep].reshape(-1, self.k)
        self.doc[old] = name[keep].reshape(-1, self.k)


def score_blocks(blocks: DataFrame, group: Group, weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best documents of every item in each task."""
    tiles, ids, size = weight_tiles(group, weight), np.array(group.ids, dtype=np.int64), len(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        place = np.full(size, -1)
        for batch in batches:
            for cells in zip(*batch.columns):
                doc, n, entries, tf = (np.frombuffer(cells[i].as_py(), dtype=np.int64) for i in (0, 1, 2, 4))
                term = np.frombuffer(cells[3].as_py(), dtype=np.int32)
                m = np.repeat(length_norm(n, n_docs, n_terms), entries)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m)
                row = np.repeat(np.arange(len(doc)), entries)
                for lo in range(0, len(doc), ROWS):
                    hi = min(lo + ROWS, len(doc))
                    a, b = np.searchsorted(row, [lo, hi])
                    for run_of_items in tiles:
                        scores = None
                        for tile in run_of_items:
                            place[tile.terms] = np.arange(len(tile.terms))
                            at = place[term[a:b]]
                            held = at >= 0
                            dense = np.zeros((hi - lo, len(tile.terms)))
                            dense[row[a:b][held] - lo, at[held]] = impact[a:b][held]
                            part = (dense @ tile.weights).astype(np.int64)
                            scores = part if scores is None else scores + part
                            place[tile.terms] = -1
                        if scores is not None:
                            best.add(scores, doc[lo:hi], run_of_items[0].items)
        item, at = np.nonzero(best.score > 0)
        # numbers of places, not ids: a repeated item is answered once a row
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array(ids[item]), pa.array(best.doc[item, at]), pa.array(best.score[item, at])],
            ["place", "item_id", "doc_id", "score"])

    return blocks.select("doc", "n", "entries", "term", "tf").mapInArrow(
        run, "place bigint, item_id bigint, doc_id bigint, score bigint")


def lexical_search(spark: SparkSession, docs: DataFrame, items: DataFrame, k: int = 10,
                   group_terms: int = GROUP_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents of every item with a score above 0.

    Terms are runs of ASCII letters, digits and non-ASCII characters of the whole text, only A-Z
    lower-cased. With N documents that hold a term, L terms in them and df documents holding a term,
    its weight is floor(1000 ln((2N + 2) / (2 df + 1))); a document of n terms that holds it tf times
    has impact (10**9 tf) div (1000 tf + 8 m), m = 25 + (75 n N) div L. Equal scores go by doc_id.

    Null texts and texts without terms hold nothing and count for nothing; rows without an id take no
    part. A repeated doc_id is another document of that id, a repeated item_id is ranked once a row.
    Empty tables give no rows.
    """
    small_batches(spark)
    nearer = Window.partitionBy("grp", "place", "part").orderBy(F.desc("score"), "doc_id")
    nearest = Window.partitionBy("grp", "place").orderBy(F.desc("score"), "doc_id")
    out = None
    for number, group in enumerate(item_groups(items, group_terms)):
        blocks = store(spark, term_blocks(docs, group.vocabulary), "term-blocks")
        total = blocks.agg(F.sum("with_terms").alias("docs"), F.sum("terms").alias("terms")).first()
        if not total["docs"]:
            break
        df = document_counts(spark, blocks, len(group.vocabulary))
        weight = np.array([term_weight(total["docs"], int(x)) if x else 0 for x in df], dtype=np.int64)
        found = store(spark, score_blocks(blocks, group, weight, total["docs"], total["terms"], k)
                      .select(F.lit(number).alias("grp"), "*"), "lexical-best")
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    # the k rows a task has for an item are cut in two steps, so that many tasks meet in no one task
    out = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(32)))
    out = out.withColumn("rank", F.row_number().over(nearer)).where(F.col("rank") <= k)
    return out.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")
