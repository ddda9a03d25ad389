"""Exact substring deduplication by compacting a de Bruijn graph of words.

Edges are the windows of ``size`` consecutive words (50), nodes the 49 words two of them share. An
edge is a repeat if a document with a smaller id holds it too; the words of repeats are removed.

The graph is never written out edge by edge. As in minimum-substring partitioning, each edge belongs to its anchor: the
least of its ``anchor``-word k-mers by hash. The consecutive edges of a document with one anchor
form a short path, some twenty edges long, kept as one row with a 128-bit fingerprint of its
words, its source coordinates (document, first words) and the paths before and after it. A path that
comes back in its document, as every period of a text that runs in circles does, is still one row. Then

1. anchors that occur in one document only hold no repeats and are dropped (a semi-join);
2. equal paths compact into one, with the least document and the least and greatest neighbour on either side: the
   node between two paths has one path in and one out where these agree on both sides;
3. such paths compact further, by pointer doubling over joins, into nonbranching paths of any length. Their parts always
   occur together, so an occurrence of the first stands for all: a long passage is one row a document;
4. the paths of an anchor with several paths branch. Their edges are opened by reading the words at the source
   coordinates of one occurrence, verified against the path's fingerprint, and
   joined by a 128-bit fingerprint of their own 50 words;
5. joined back to the occurrences, edges and long paths give the spans to remove in each document.

Groups of copies collapse in the partial aggregates of steps 1 and 2; no step brings the rows of an
anchor, path or edge together, so a hot one can be split. Equal means equal in two independent
64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.llm.tables import if_small, small_batches, store
from assetlane.llm.words import Spans, Words, chunks, mix, normal_text, split

SIZE, ANCHOR = 50, 12
_LOW = np.uint64(0xFFFFFF)
_SIDES = ["before_lo", "before_hi", "after_lo", "after_hi"]
_PATH = pa.struct([(c, pa.int64()) for c in ("anchor", "path", "proof", *_SIDES)]
                  + [("starts", pa.list_(pa.int32())), ("edges", pa.int32())])
_SPAN = "array<struct<lo:int,hi:int>>"


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def doc_keys(w: Words, spans: Spans) -> np.ndarray:
    """Hash of the whole word sequence of each text: tells apart rows that share a doc_id."""
    return signed(spans.of(w.first[:-1], np.diff(w.first)))


def paths_of(w: Words, spans: Spans, size: int, anchor: int):
    """First edge, number of edges and anchor hash of each nonbranching path, in order."""
    n = len(w.code)
    if n < size:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(np.uint64)
    kmer = spans.of(np.arange(n - anchor + 1), anchor)
    # the hash above, the position below: the least is the leftmost of the smallest
    key = mix(kmer) & ~_LOW | np.arange(len(kmer), dtype=np.uint64) & _LOW
    least = sliding_min(key, size - anchor + 1)
    start = np.arange(n - size + 1)
    doc = w.doc
    inside = doc[:n - size + 1] == doc[size - 1:]
    start, least = start[inside], least[inside]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (np.diff(start) != 1)
    at = np.flatnonzero(new)
    first = start[at]
    where = first + ((least[at] & _LOW).astype(np.int64) - first & 0xFFFFFF)
    return first, np.diff(np.append(at, len(start))), kmer[where]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))


def paths(docs: DataFrame, size: int, anchor: int) -> DataFrame:
    """doc_id, key and the distinct nonbranching paths of every document that has an edge and an id, each with all its
    starts and the least and greatest neighbour on either side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                w = split(texts[lo:hi])
                spans, proof = Spans(w.code), Spans(w.code, 1)
                first, edges, anchors = paths_of(w, spans, size, anchor)
                doc = w.doc[first] if len(first) else first
                length = edges + (size - 1)
                path, check = signed(spans.of(first, length)), signed(proof.of(first, length))
                # the neighbours in the document; 0 at its ends
                before, after = np.zeros_like(path), np.zeros_like(path)
                same = doc[1:] == doc[:-1]
                before[1:][same], after[:-1][same] = path[:-1][same], path[1:][same]
                order = np.lexsort((first, check, path, anchors, doc))
                again = np.zeros(len(order), dtype=bool)
                again[1:] = np.all([c[order][1:] == c[order][:-1] for c in (doc, anchors, path, check)], axis=0)
                at = np.flatnonzero(~again)
                one = order[at]
                sides = [f.reduceat(c[order], at) if len(at) else c
                         for c in (before, after) for f in (np.minimum, np.maximum)]
                starts = pa.ListArray.from_arrays(pa.array(np.append(at, len(order)).astype(np.int32)),
                                                  pa.array((first - w.first[doc])[order].astype(np.int32)))
                doc = doc[one]
                rows = pa.StructArray.from_arrays(
                    [*map(pa.array, (signed(anchors)[one], path[one], check[one], *sides)), starts,
                     pa.array(edges[one].astype(np.int32))], fields=list(_PATH))
                bounds = np.searchsorted(doc, np.arange(hi - lo + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(doc_keys(w, spans)),
                     pa.ListArray.from_arrays(pa.array(bounds), rows)], ["doc_id", "key", "paths"])

    item = ",".join(f"{c}:bigint" for c in ("anchor", "path", "proof", *_SIDES)) + ",starts:array<int>,edges:int"
    return (docs.where("doc_id IS NOT NULL")
            .mapInArrow(run, f"doc_id bigint, key bigint, paths array<struct<{item}>>")
            .where(F.size("paths") > 0))


def open_edges(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """The edges of the wanted paths, read at their source coordinates.

    ``wanted`` has one row a document: doc_id and ``asked``, an array of structs (key, start, edges,
    path, proof, number). A text answers only for paths whose fingerprints its words give again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [t or b"" for t in texts]
            asked = batch.column(2).to_pylist()
            for lo, hi in chunks(texts):
                w = split(texts[lo:hi])
                spans, proof = Spans(w.code), Spans(w.code, 1)
                keys, many = doc_keys(w, spans), np.diff(w.first)
                out = [(w.first[d] + a["start"], a["edges"], a["number"], ids[lo + d], a["path"], a["proof"])
                       for d in range(hi - lo) for a in asked[lo + d]
                       if a["key"] == keys[d] and a["start"] + a["edges"] + size - 1 <= many[d]]
                if not out:
                    continue
                start, edges, number, doc, path, check = (np.array(c, dtype=np.int64) for c in zip(*out))
                good = (signed(spans.of(start, edges + size - 1)) == path) & (
                    signed(proof.of(start, edges + size - 1)) == check)
                start, edges, number, doc = start[good], edges[good], number[good], doc[good]
                step = np.arange(edges.sum()) - np.repeat(np.cumsum(edges) - edges, edges)
                at = np.repeat(start, edges) + step
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(spans.of(at, size))), pa.array(signed(proof.of(at, size))),
                     pa.array(np.repeat(number, edges)), pa.array(step.astype(np.int32)),
                     pa.array(np.repeat(doc, edges))], ["edge", "edge_proof", "number", "step", "doc_id"])

    joined = docs.join(wanted, "doc_id").select("doc_id", "text", "asked")
    return joined.mapInArrow(run, "edge bigint, edge_proof bigint, number bigint, step int, doc_id bigint")


def repeated_spans(spark: SparkSession, docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document with something to remove: doc_id and ``cuts``, an array of structs
    (key, spans), where spans are disjoint ranges of word positions in order.

    Documents without an id neither remove nor lose anything. Rows that share an id do not remove
    from each other; ``key`` tells their texts apart. A text below ``size`` words loses nothing.
    """
    texts = _texts(docs, id_col, text_col)
    stored = store(spark, paths(texts, size, anchor), "paths")
    rows = stored.select("doc_id", "key", F.inline("paths"))
    shared = store(spark, rows.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                   .where("lo < hi").select("anchor"), "shared-anchors")
    rows = store(spark, rows.join(if_small(shared, 8), "anchor", "left_semi"), "repeated-anchors")
    path = ["anchor", "path", "proof"]
    compact = rows.groupBy(*path).agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("key", "doc_id").alias("key"),
        F.min_by(F.get("starts", 0), "doc_id").alias("start"), F.max("edges").alias("edges"),
        *[(F.min if c.endswith("lo") else F.max)(c).alias(c) for c in _SIDES],
    ).withColumn("number", F.monotonically_increasing_id())
    compact = store(spark, compact, "compact-paths")
    branching = store(spark, compact.groupBy("anchor").count().where("count > 1").select("anchor"), "branching-anchors")
    asked = F.struct("key", "start", "edges", "path", "proof", "number")
    wanted = store(spark, compact.join(if_small(branching, 8), "anchor", "left_semi")
                   .groupBy(F.col("first").alias("doc_id")).agg(F.collect_list(asked).alias("asked")),
                   "branching-paths")
    edges = store(spark, open_edges(texts, if_small(wanted, 56, "asked"), size), "edges")
    merged = store(spark, edges.groupBy("edge", "edge_proof").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"), "shared-edges")
    late = (edges.join(merged, ["edge", "edge_proof"]).where("lo < doc_id")
            .groupBy("number").agg(F.collect_list("step").alias("steps")))
    longest = long_paths(spark, compact.where("first < last"))
    span = lambda lo, words: F.struct(lo.alias("lo"), (lo + words).alias("hi"))
    whole = (rows.drop("edges").join(longest.select(*path, "first", "edges"), path).where("first < doc_id")
             .select("doc_id", "key", F.transform("starts", lambda at: span(at, F.col("edges") + size - 1)).alias("spans")))
    # in the first document of a path some edges may still have a smaller one
    some = F.flatten(F.transform("starts", lambda at: F.transform("steps", lambda s: span(at + s, F.lit(size)))))
    partly = compact.join(late, "number").select(*path, F.col("first").alias("doc_id"), "steps")
    part = rows.join(partly, [*path, "doc_id"]).select("doc_id", "key", some.alias("spans"))
    found = whole.unionByName(part).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return store(spark, found.select("doc_id", "key", _union("spans").alias("spans"))
                 .groupBy("doc_id").agg(F.collect_list(F.struct("key", "spans")).alias("cuts")),
                 "cuts")


def long_paths(spark: SparkSession, compact: DataFrame) -> DataFrame:
    """Paths that always follow each other, compacted: the row of the first, with the edges of all.

    A path goes on into another if every occurrence of the one is followed by the other and every occurrence of
    the other preceded by the one. Texts end, so such links form no circle. Each round doubles how far a path sees
    towards the first one; rows are compacted paths, never occurrences.
    """
    ends = compact.where("after_lo = after_hi AND after_lo <> 0").select(
        F.col("number").alias("up"), F.col("path").alias("from"), F.col("after_lo").alias("to"))
    begins = compact.where("before_lo = before_hi AND before_lo <> 0").select(
        F.col("number").alias("member"), F.col("before_lo").alias("from"), F.col("path").alias("to"))
    links = store(spark, begins.join(ends, ["from", "to"]).select("member", "up"), "path-links")
    while True:
        above = links.select(F.col("member").alias("up"), F.col("up").alias("further"))
        step = store(spark, links.join(above, "up", "left").select(
            "member", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "path-links")
        links = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    whole = compact.select(F.col("number").alias("member"), "edges").join(links, "member", "left").groupBy(
        F.coalesce("up", "member").alias("number")).agg(F.sum("edges").cast("int").alias("edges"))
    return store(spark, compact.drop("edges").join(whole, "number"), "long-paths")


def _union(spans: str) -> Column:
    """Disjoint ranges, in order, that cover the same positions."""
    @F.pandas_udf(_SPAN)
    def union(column: pd.Series) -> pd.Series:
        out = []
        for items in column:
            merged: list[list[int]] = []
            for s in sorted((s["lo"], s["hi"]) for s in items):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append(list(s))
            out.append([{"lo": a, "hi": b} for a, b in merged])
        return pd.Series(out)

    return union(spans)


def remove_spans(docs: DataFrame, cuts: DataFrame, id_col: str = "doc_id",
                 text_col: str = "text", texts: bool = True, carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` as doc_id, n_words, n_removed, kept_sha256, with ``texts`` text, and the
    columns named in ``carry``.

    ``text`` keeps the bytes of a document that loses nothing; of others it has the words that are
    kept, each with the white space that followed it. ``kept_sha256`` is of the kept words joined by
    one space. A null text has no words and stays null.
    """
    small_batches(docs.sparkSession)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * texts
    extra = list(carry or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = batch.column(1).to_pylist()
            bodies = [t or b"" for t in given]
            cut = batch.column(2).to_pylist()
            for lo, hi in chunks(bodies):
                w = split(bodies[lo:hi])
                keys = doc_keys(w, Spans(w.code))
                removed, digest, out = [], [], []
                for d in range(hi - lo):
                    a, b = int(w.first[d]), int(w.first[d + 1])
                    spans = next((c["spans"] for c in cut[lo + d] or () if c["key"] == keys[d]), ())
                    keep = None
                    if spans:
                        keep = np.ones(b - a, dtype=bool)
                        for s in spans:
                            keep[s["lo"]:s["hi"]] = False
                    removed.append(0 if keep is None else int((~keep).sum()))
                    digest.append(hashlib.sha256(normal_text(w, a, b, keep)).hexdigest())
                    if texts:
                        out.append(given[lo + d] if keep is None else _kept(w, d, a, b, keep))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(w.first)),
                           pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
                if texts:
                    columns.append(pa.array(out, pa.binary()))
                columns += [batch.column(i).slice(lo, hi - lo) for i in range(3, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names + extra)

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", text binary" * texts
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in extra)
    rows = docs.select(F.col(id_col).cast("bigint").alias("__id"), F.col(text_col).cast("binary").alias("__text"),
                       *[F.col(c) for c in extra])
    cuts = cuts.select(F.col("doc_id").alias("__id"), F.col("cuts").alias("__cuts"))
    joined = rows.join(if_small(cuts, 48, "__cuts"), "__id", "left")
    out = joined.select("__id", "__text", "__cuts", *extra).mapInArrow(run, schema)
    return out.withColumn("text", F.col("text").cast("string")) if texts else out


def _kept(w: Words, d: int, a: int, b: int, keep: np.ndarray) -> bytes:
    """Kept words, each with what follows it up to the next word."""
    base, end = int(w.offset[d]), int(w.offset[d + 1]) - 1
    take = np.ones(end - base, dtype=np.int8)
    follow = np.append(w.start[a + 1:b], end) - base
    mark = np.zeros(end - base + 1, dtype=np.int8)
    gone = ~keep
    np.add.at(mark, w.start[a:b][gone] - base, 1)
    np.add.at(mark, follow[gone], -1)
    take = np.cumsum(mark[:-1]) == 0
    return w.buf[base:end][take].tobytes()


def substring_dedup(spark: SparkSession, docs: DataFrame, size: int = SIZE, anchor: int = ANCHOR,
                    id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Removes each word covered by a window of ``size`` words that a smaller doc_id also holds.

    All windows are judged on the input. Returns every row (see ``remove_spans``); an empty table
    gives no rows, and columns other than the id and the text are not read.
    """
    cuts = repeated_spans(spark, docs, size, anchor, id_col, text_col)
    return remove_spans(docs, cuts, id_col, text_col, texts)
