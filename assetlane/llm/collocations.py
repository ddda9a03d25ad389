"""Phrase collocations: contiguous phrases counted by direct-address tiles, scored at their weakest cut.

Level 1 counts the words of each language, level 2 pairs of adjacent words, level 3 pairs of adjacent pairs
(which share a word, so they are phrases of three words), and so on: every level counts adjacent *units*
of the one below it. A phrase seen ``least`` times consists of units seen as often, so a task needs
to count only pairs of frequent units:

* the most frequent units (at most ``HEAD``, cut at a step of a histogram of frequencies) are ranked by frequency
  and sent to the tasks; the rank is their address;
* pairs of ranks fall into tiles of ``TILE`` x ``TILE``. Tiles with many pairs are counted by ``np.bincount`` into
  a dense array, all others as coordinates, sorted and run-length counted;
* units beyond the head keep their hash, and pairs with one of them are counted as coordinates.
  A bitmap of fixed size tells which units may be frequent; it errs on one side only, so infrequent
  ones cost work but nothing frequent is lost;
* the partial counts are summed by Spark; pairs seen often enough are the frequent units of the next
  level and are ranked anew.

Units are told apart by 63-bit hashes of their language and bytes, or of their two parts. Between tasks a
unit is its rank, which packs well, or -1 - hash where it has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlane.llm.tables import small_batches, store
from assetlane.llm.words import FOLD, chunks, codes_of, mix

#: ranked units sent to tasks; ranks a tile side; pairs that make a tile dense
HEAD, TILE, DENSE = 1 << 18, 1 << 10, 1 << 15
#: pairs a task holds before it passes counts on; distinct words likewise
HELD, HELD_WORDS = 1 << 22, 1 << 19
#: the bitmap of frequent units: as many numbers of 64 bits
SLOTS = 1 << 20

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True


@dataclass
class Sequence:
    """Words of texts of one language in order; ``piece`` differs between words that cannot form a phrase."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    code: np.ndarray
    piece: np.ndarray


def read_words(texts: list[bytes], lang: str) -> Sequence:
    buf = FOLD[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    inside = np.zeros(len(buf) + 2, dtype=np.int8)
    inside[1:-1] = ~_GAP[buf]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # the line feed after each text ends its last piece
    piece = np.cumsum(_BREAK[buf], dtype=np.int64)[start]
    name = np.frombuffer(lang.encode() or b" ", dtype=np.uint8)
    salt = codes_of(name, np.array([0]), np.array([len(name)]))[0] if lang else np.uint64(0)
    return Sequence(buf, start, end, mix(codes_of(buf, start, end) ^ mix(np.array([salt]))) >> np.uint64(1), piece)


def join_codes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The hash of a unit made of two."""
    return mix(mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) + y) >> np.uint64(1)


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Sequence]]:
    """Whole texts of a (lang, text) table, some MB of one language at a time."""
    for batch in batches:
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                by_lang.setdefault(lang, []).append(text.encode())
        for lang, texts in by_lang.items():
            for lo, hi in chunks(texts):
                yield lang, read_words(texts[lo:hi], lang)


def as_long(code: np.ndarray) -> pa.Array:
    return pa.array(code.view(np.int64))


def slices(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Slices of a buffer as a column of strings."""
    size = end - start
    offset = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(offset[-1]) + np.repeat(start - offset[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(buf[at]))


def count_words(docs: DataFrame) -> DataFrame:
    """code, lang, word and n of every word of every language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(parts: list) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts).combine_chunks()
            code, first, back = np.unique(table.column("code").to_numpy(), return_index=True, return_inverse=True)
            n = np.bincount(back, weights=table.column("n").to_numpy()).astype(np.int64)
            rest = table.take(pa.array(first))
            return pa.RecordBatch.from_arrays([pa.array(code), *(rest.column(c).combine_chunks() for c in ("lang", "word")), pa.array(n)], table.schema.names)

        parts, held = [], 0
        for lang, s in sequences(batches):
            code, first, n = np.unique(s.code, return_index=True, return_counts=True)
            words = slices(s.buf, s.start[first], s.end[first])
            parts.append(pa.RecordBatch.from_arrays([as_long(code), pa.array([lang] * len(code), pa.string()), words, pa.array(n)], ["code", "lang", "word", "n"]))
            held += len(code)
            if held >= HELD_WORDS:
                parts = [told(parts)]
                if parts[0].num_rows > HELD_WORDS // 2:
                    yield parts.pop()
                held = sum(p.num_rows for p in parts)
        if parts:
            yield told(parts)

    return docs.mapInArrow(run, "code bigint, lang string, word string, n bigint").groupBy("code", "lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Units:
    """What tasks know of the frequent units of a level: ranked head and bitmap."""

    code: np.ndarray   # of the head, sorted
    rank: np.ndarray   # of these codes
    by_rank: np.ndarray
    bits: np.ndarray

    def may_be_frequent(self, code: np.ndarray) -> np.ndarray:
        return (self.bits[(code >> np.uint64(6)) & np.uint64(len(self.bits) - 1)] >> (code & np.uint64(63))) & np.uint64(1) != 0

    def ranks(self, code: np.ndarray) -> np.ndarray:
        """Ranks of units, -1 beyond the head."""
        if not len(self.code):
            return np.full(len(code), -1)
        at = np.searchsorted(self.code, code)
        at[at == len(self.code)] = 0
        return np.where(self.code[at] == code, self.rank[at], -1)

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Hashes of units given as ranks, or -1 - hash."""
        out = (-1 - unit).view(np.uint64)
        ranked = unit >= 0
        out[ranked] = self.by_rank[unit[ranked]]
        return out


def ranked_units(frequent: DataFrame, head: int) -> Units:
    """Head and bitmap of a table (code, n); both are bounded whatever the table."""
    step = F.floor(F.log2("n") * 64).cast("int")
    steps = frequent.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("units")).orderBy(F.desc("step")).collect()
    total, floor = 0, None
    for s in steps:  # some 64 a power of two
        total += s["units"]
        if total > head:
            break
        floor = s["step"]
    none = np.empty(0, np.uint64)
    code, rank, by_rank = none, none.astype(np.int64), none
    if floor is not None:
        top = frequent.where(step >= floor).select("code", "n").toArrow()
        have = top["code"].to_numpy().view(np.uint64)
        by_rank = have[np.lexsort((have, -top["n"].to_numpy()))]
        order = np.argsort(by_rank)
        code, rank = by_rank[order], order
    slot = F.shiftrightunsigned("code", 6).bitwiseAND(F.lit(SLOTS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("code").bitwiseAND(F.lit(63)).cast("int"))
    words = frequent.groupBy(slot.alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()  # at most SLOTS rows
    bits = np.zeros(SLOTS, dtype=np.uint64)
    bits[words["slot"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Units(code, rank, by_rank, bits)


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where equal rows of sorted columns begin, and how many there are."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(new)))


def count_pairs(x: np.ndarray, y: np.ndarray, units: Units) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct pairs of units (ranks, or -1 - hash) and their numbers: pairs beyond the head, dense tiles, sparse tiles."""
    i, j = units.ranks(x), units.ranks(y)
    tail = (i < 0) | (j < 0)
    if tail.any():
        a = np.where(i < 0, -1 - x.view(np.int64), i)[tail]
        b = np.where(j < 0, -1 - y.view(np.int64), j)[tail]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first, n = runs(a, b)
        yield a[first], b[first], n
        i, j = i[~tail], j[~tail]
    if not len(i):
        return
    side = -(-len(units.by_rank) // TILE)
    tile = (i // TILE) * side + j // TILE
    dense = np.bincount(tile, minlength=side * side) >= DENSE
    for t in np.flatnonzero(dense):
        at = np.flatnonzero(tile == t)
        cells = np.bincount((i[at] % TILE) * TILE + j[at] % TILE, minlength=TILE * TILE)
        some = np.flatnonzero(cells)
        yield t // side * TILE + some // TILE, t % side * TILE + some % TILE, cells[some]
    sparse = ~dense[tile]
    if sparse.any():
        key = np.sort(i[sparse] * len(units.by_rank) + j[sparse])
        first, n = runs(key)
        yield key[first] // len(units.by_rank), key[first] % len(units.by_rank), n


def adjacent_pairs(docs: DataFrame, levels: list[Units]) -> DataFrame:
    """x, y and n of adjacent frequent units of the last of ``levels``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(held: list) -> Iterator[pa.RecordBatch]:
            x, y = (np.concatenate(p) for p in zip(*held))
            for columns in count_pairs(x, y, levels[-1]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "y", "n"])

        held, size = [], 0
        for _, s in sequences(batches):
            code, near = s.code, s.piece[1:] == s.piece[:-1]
            good = levels[0].may_be_frequent(code)
            for deeper in levels[1:]:
                pair = np.flatnonzero(near & good[1:] & good[:-1])
                joined = np.zeros(max(len(code) - 1, 0), dtype=np.uint64)
                joined[pair] = join_codes(code[pair], code[pair + 1])
                good = np.zeros(len(joined), dtype=bool)
                good[pair] = deeper.may_be_frequent(joined[pair])
                code, near = joined, near[1:]
            at = np.flatnonzero(near & good[1:] & good[:-1])
            if len(at):
                held.append((code[at], code[at + 1]))
                size += len(at)
            if size >= HELD:
                yield from told(held)
                held, size = [], 0
        if held:
            yield from told(held)

    return docs.mapInArrow(run, "x bigint, y bigint, n bigint")


def with_code(pairs: DataFrame, units: Units) -> DataFrame:
    """x and y as hashes, and code, the hash of the pair as a unit of the next level."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (units.codes(batch.column(i).to_numpy()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [as_long(x), as_long(y), batch.column(2), as_long(join_codes(x, y))], ["x", "y", "n", "code"])

    return pairs.mapInArrow(run, "x bigint, y bigint, n bigint, code bigint")


def weakest_cut(a: Column, cuts: list[tuple[Column, Column]]) -> Column:
    """struct(score, k, l, r) of the cut with the lowest floor(10**6 a * a / (l * r)), the first of equals.

    Numbers are decimals of 38 digits, so frequencies up to 10**13 multiply exactly."""
    big = a.cast("decimal(13,0)")

    def score(left: Column, right: Column) -> Column:
        top = big * big * F.lit(1_000_000).cast("decimal(7,0)")
        return F.call_function("div", top, left.cast("decimal(13,0)") * right.cast("decimal(13,0)"))

    return F.array_min(F.array(*[
        F.struct(score(left, right).alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))
        for k, (left, right) in enumerate(cuts, 1)]))


def collocations(spark: SparkSession, docs: DataFrame, least: int = 10, top: int = 2000, covered: int = 50,
                 head: int = HEAD) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the ``top`` phrases of two or three words of each language.

    A-Z are lower-cased, texts are split at ``.,;:!?`` and line breaks into pieces, pieces at spaces and tabs into
    words. ``n`` counts the words of the language, ``a`` the occurrences of the phrase inside pieces
    (at least ``least``), ``l`` and ``r`` those of its parts at the cut with the lowest score. A pair of words
    inside a phrase of three seen at least ``covered`` % as often is left out. Order: score, a, both
    descending, then the bytes of the phrase.

    A null language is ``und``, a null text is empty. Repeated rows count again. An empty table gives no rows;
    so does a language without a phrase. ``head`` only decides how the work is cut.
    """
    small_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    words = store(spark, count_words(texts), "words")
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = words.where(F.col("n") >= least)
    levels = [ranked_units(frequent, head)]

    def counted(name: str) -> DataFrame:
        pairs = adjacent_pairs(texts, levels).groupBy("x", "y").agg(F.sum("n").alias("n"))
        return store(spark, with_code(pairs.where(F.col("n") >= least), levels[-1]), name)

    pairs = counted("word-pairs")
    levels.append(ranked_units(pairs, head))
    triples = counted("word-triples")

    word = frequent.select("code", "lang", "word", "n")
    two = store(spark, pairs.select("x", "y", F.col("n").alias("a"), "code")
                .join(word.select(F.col("code").alias("x"), "lang", F.col("word").alias("first"), F.col("n").alias("n_first")), "x")
                .join(word.select(F.col("code").alias("y"), F.col("word").alias("last"), F.col("n").alias("n_last")), "y")
                .select("code", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "last", "a", "n_first", "n_last"), "named-pairs")
    three = store(spark, triples.select("x", "y", F.col("n").alias("a"))
                  .join(two.select(F.col("code").alias("x"), "lang", "phrase", F.col("a").alias("a_first"), "n_first"), "x")
                  .join(two.select(F.col("code").alias("y"), "last", F.col("a").alias("a_last"), "n_last"), "y"), "named-triples")
    longer = three.select(F.explode(F.array("x", "y")).alias("code"), "a").groupBy("code").agg(F.max("a").alias("longer"))
    short = two.join(longer, "code", "left").where(f"longer IS NULL OR 100 * longer < {int(covered)} * a").select(
        "lang", "phrase", "a", weakest_cut(F.col("a"), [(F.col("n_first"), F.col("n_last"))]).alias("cut"))
    long = three.select("lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "a", weakest_cut(
        F.col("a"), [(F.col("n_first"), F.col("a_last")), (F.col("a_first"), F.col("n_last"))]).alias("cut"))
    scored = short.union(long).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # a language's phrases are cut to ``top`` in 32 parts before they meet in one
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(32))).orderBy(*order)
    best = scored.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(total, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("bigint").alias("score"))
