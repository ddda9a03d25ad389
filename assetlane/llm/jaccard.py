"""Near-duplicate documents: an exact set-similarity join on word n-grams, and its components.

Documents with J(x, y) >= threshold must share a token (n-gram) among the first
``n - ceil(t n) + 1`` of each when all tokens are put in one global order. Rare tokens come first:
the order is by the octave of the token's frequency, then by its hash. Frequencies are counted over
all documents, in blocks of which each adds the tokens it holds twice; the most frequent are listed,
at most ``2 ** common_bits`` of them whatever the corpus, and all others count as rare. Any fixed
order gives the same, exact result; the list only decides how small the buckets are.

1. Documents with one token set form a class; only classes are compared.
2. Prefix tokens held by a single class are dropped. Where a prefix holds all rare tokens of its set,
   those of them found in no other prefix match nothing; too many, and the class cannot link.
3. In each bucket (classes with one prefix token) all members meet one pivot, the one with the
   fewest such tokens. Candidates pass the length, positional and suffix filters and are verified on their texts, each pair once.
4. Members found linked are one component and need no further comparison with each other. Buckets
   within one component are done; this is what keeps a group of copies linear.
5. Pivots are repeated while they merge much; then all remaining pairs across components
   are verified. So every candidate pair is verified or already connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.llm.components import components
from assetlane.llm.tables import if_small, store
from assetlane.llm.words import Spans, chunks, mix, split

N, PERCENT, COMMON_BITS, BLOCK_TOKENS = 5, 80, 21, 4 << 20
PART_BITS = 8
PARTS = 1 << PART_BITS
USED = ("n", "pos", "whole", "c")


def token_sets(texts: list[bytes], n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text, ascending, and where each text's begin.

    A text of fewer words has one token, its whole sequence; one without words has none.
    """
    w = split(texts, fold=True)
    spans, many = Spans(w.code), np.diff(w.first)
    start = np.arange(max(0, len(w.code) - n + 1))
    doc = w.doc
    start = start[doc[:len(start)] == doc[n - 1:]] if len(start) else start
    short = np.flatnonzero((many > 0) & (many < n))
    code = np.concatenate([spans.of(start, n), spans.of(w.first[short], many[short])])
    owner = np.concatenate([doc[start], short])
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.ones(len(code), dtype=bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    code, owner = code[new], owner[new]
    return code, np.searchsorted(owner, np.arange(len(texts) + 1))


def set_keys(code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set, from sums over its tokens."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(code ^ np.uint64(salt)), dtype=np.uint64)])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def part_sizes(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many tokens of each set fall into each of ``PARTS`` parts by hash, at most 255."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    part = owner * PARTS + (code >> np.uint64(64 - PART_BITS)).astype(np.int64)
    return np.minimum(np.bincount(part, minlength=PARTS * (len(first) - 1)), 255).astype(np.uint8).reshape(-1, PARTS)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))


def common_tokens(spark: SparkSession, texts: DataFrame, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens, ascending, and the octave of their counts; at most ``2 ** bits`` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, used = np.empty(BLOCK_TOKENS, dtype=np.uint64), 0

        def twice(code: np.ndarray) -> pa.RecordBatch:
            code.sort()
            again, more = np.unique(code[1:][code[1:] == code[:-1]], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(again.view(np.int64)), pa.array(more + 1)], ["token", "n"])

        for batch in batches:
            bodies = [t or b"" for t in batch.column(0).to_pylist()]
            for lo, hi in chunks(bodies):
                code = token_sets(bodies[lo:hi], n)[0]
                if used + len(code) > BLOCK_TOKENS:
                    yield twice(buffer[:used])
                    used = 0
                if len(code) > BLOCK_TOKENS:
                    yield twice(code)
                else:
                    buffer[used:used + len(code)] = code
                    used += len(code)
        yield twice(buffer[:used])

    counted = store(spark, texts.select("text").mapInArrow(run, "token bigint, n bigint")
                    .groupBy("token").agg(F.sum("n").alias("n")), "token-counts")
    step = F.floor(F.log2("n") * 8).cast("int")
    sizes = (counted.groupBy(step.alias("step")).count()
             .orderBy(F.desc("step")).collect())  # some 8 rows an octave
    least, held = None, 0
    for r in sizes:
        held += r["count"]
        if held > 1 << bits:
            break
        least = r["step"]
    listed = counted.where(step >= least if least is not None else F.lit(False)).select(
        "token", F.floor(F.log2(F.col("n") + 1)).cast("tinyint").alias("octave")).toArrow()
    code = listed["token"].to_numpy().view(np.uint64)
    order = np.argsort(code)
    return code[order], listed["octave"].to_numpy()[order].astype(np.uint8)


def document_sets(spark: SparkSession, texts: DataFrame, n: int, percent: int, bits: int) -> DataFrame:
    """row, doc_id, set size n, set hashes k1 and k2, and the prefix in the global order."""
    common = spark.sparkContext.broadcast(common_tokens(spark, texts, n, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, octave = common.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            bodies = [t or b"" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(bodies):
                code, first = token_sets(bodies[lo:hi], n)
                size = np.diff(first)
                rank = np.zeros(len(code), dtype=np.uint64)
                if len(listed):
                    at = np.minimum(np.searchsorted(listed, code), len(listed) - 1)
                    rank = np.where(listed[at] == code, octave[at], 0).astype(np.uint64)
                owner = np.repeat(np.arange(hi - lo), size)
                order = np.lexsort((rank << np.uint64(58) | code >> np.uint64(6), owner))
                place = np.arange(len(code)) - np.repeat(first[:-1], size)
                length = prefix_length(size, percent)
                take = place < np.repeat(length, size)
                k1, k2 = set_keys(code, first)
                parts = part_sizes(code, first)
                rare = np.bincount(owner, rank == 0, minlength=hi - lo).astype(np.int64)
                bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo),
                     pa.array(size), pa.array(rare), pa.array(k1), pa.array(k2),
                     pa.array([p.tobytes() for p in parts], pa.binary()),
                     pa.ListArray.from_arrays(pa.array(bounds), pa.array(code[order][take].view(np.int64)))],
                    ["row", "doc_id", "n", "rare", "k1", "k2", "parts", "prefix"])
                row += hi - lo

    sets = store(spark, texts.mapInArrow(
        run, "row bigint, doc_id bigint, n bigint, rare bigint, k1 bigint, k2 bigint, parts binary, prefix array<bigint>"), "sets")
    common.unpersist()
    return sets


def may_link(x: dict[str, Column], y: dict[str, Column], percent: int) -> Column:
    """Length, positional and matchable-token filters for two entries of one token.

    ``whole`` says that all rare tokens of a set are in its prefix. If that holds for both sets, a rare
    token that no other prefix holds cannot be in both, so at most ``c`` tokens of each can match.
    """
    need = percent * (x["n"] + y["n"])
    length = (100 * x["n"] >= percent * y["n"]) & (100 * y["n"] >= percent * x["n"])
    most = F.least(x["pos"], y["pos"]) + 1 + F.least(x["n"] - x["pos"], y["n"] - y["pos"]) - 1
    matchable = ~(x["whole"] & y["whole"]) | ((100 + percent) * F.least(x["c"], y["c"]) >= need)
    return length & ((100 + percent) * most >= need) & matchable


def with_matchable(spark: SparkSession, entries: DataFrame, percent: int) -> DataFrame:
    """Entries with ``whole`` and ``c`` (see ``may_link``), without those that cannot link at all."""
    whole = F.col("rare") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    counted = store(spark, entries.groupBy("node").agg(
        F.first("n").alias("n"), F.first("rare").alias("rare"), F.sum((F.col("pos") < F.col("rare")).cast("bigint")).alias("met"))
        .select("node", whole.alias("whole"), F.when(whole, F.col("n") - F.col("rare") + F.col("met")).otherwise(F.col("n")).alias("c")), "matchable")
    out = entries.drop("rare").join(if_small(counted, 24), "node")
    least = store(spark, out.groupBy("token").agg(F.min("n").alias("low"), F.min("whole").alias("all"), F.count(F.lit(1)).alias("m")), "buckets")
    other = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100))
    kept = out.join(least, "token").where(
        (F.col("m") > 1) & (~F.col("all") | ((100 + percent) * F.col("c") >= percent * (F.col("n") + other))))
    return store(spark, kept.select("token", "node", "n", "pos", "whole", "c"), "entries")


def suffix_filter(spark: SparkSession, pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets can still reach the threshold by the sizes of their parts.

    Tokens that differ between two parts differ between the sets, so the summed differences of the
    part sizes bound the symmetric difference from below. ``parts`` has node, n and parts.
    """
    def side(name: str) -> DataFrame:
        return parts.select(F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("parts").alias(f"{name}_parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, PARTS)
                    for i in (4, 5))
            apart = (np.maximum(a, b) - np.minimum(a, b)).sum(axis=1, dtype=np.int64)
            good = pa.array((100 + percent) * ((n - apart) // 2) >= percent * n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(good)

    joined = pairs.join(side("x"), "x").join(side("y"), "y")
    return joined.select("x", "y", "x_n", "y_n", "x_parts", "y_parts").mapInArrow(run, "x bigint, y bigint")


def verify(spark: SparkSession, pairs: DataFrame, classes: DataFrame, texts: DataFrame,
           n: int, percent: int) -> DataFrame:
    """The pairs (x, y) of classes whose texts reach the threshold. ``pairs`` is a stored table."""
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    wanted = store(spark, classes.join(nodes, "node", "left_semi").select("node", "doc_id", "k1", "k2"), "wanted")
    bodies = store(spark, texts.join(if_small(wanted, 40), "doc_id").select("node", "k1", "k2", "text"), "candidate-texts")

    def side(name: str) -> DataFrame:
        return bodies.select(F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("k1", "k2", "text")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (0, 1))
            keys = [batch.column(i).to_pylist() for i in range(2, 6)]
            bodies = [batch.column(i) for i in (6, 7)]
            sizes = [len(a.as_py()) + len(b.as_py()) for a, b in zip(*bodies)]
            lo = held = 0
            for hi in range(1, len(x) + 1):
                held += sizes[hi - 1]
                if held < 2 << 20 and hi < len(x):
                    continue
                good = _linked(x[lo:hi], y[lo:hi], [k[lo:hi] for k in keys],
                               bodies[0].slice(lo, hi - lo), bodies[1].slice(lo, hi - lo), n, percent)
                yield pa.RecordBatch.from_arrays([pa.array(x[lo:hi], pa.int64()).filter(good),
                                                  pa.array(y[lo:hi], pa.int64()).filter(good)], ["x", "y"])
                lo, held = hi, 0

    joined = pairs.join(side("y"), "y").join(side("x"), "x").select(
        "x", "y", "x_k1", "x_k2", "y_k1", "y_k2", "x_text", "y_text")
    return store(spark, joined.mapInArrow(run, "x bigint, y bigint").distinct(), "verified-links")


def _linked(x: list, y: list, keys: list, xs: pa.Array, ys: pa.Array, n: int, percent: int) -> pa.Array:
    place: dict[tuple, int] = {}
    bodies: list[bytes] = []
    ends = []
    for node, k1, k2, body in ((x, keys[0], keys[1], xs), (y, keys[2], keys[3], ys)):
        side = []
        for i, key in enumerate(zip(node, k1, k2)):
            text = body[i].as_py()
            at = place.setdefault((*key, hash(text)), len(bodies))
            if at == len(bodies):
                bodies.append(text)
            side.append(at)
        ends.append(side)
    code, first = token_sets(bodies, n)
    k1, k2 = set_keys(code, first)
    good = []
    for i, (a, b) in enumerate(zip(*ends)):
        s, t = code[first[a]:first[a + 1]], code[first[b]:first[b + 1]]
        same = (k1[a], k2[a], k1[b], k2[b]) == (keys[0][i], keys[1][i], keys[2][i], keys[3][i])
        if not same or not len(s) or not len(t):
            good.append(False)
            continue
        at = np.minimum(np.searchsorted(t, s), len(t) - 1)
        both = int((t[at] == s).sum())
        good.append(100 * both >= percent * (len(s) + len(t) - both))
    return pa.array(good, pa.bool_())


def link_classes(spark: SparkSession, classes: DataFrame, entries: DataFrame, parts: DataFrame, texts: DataFrame,
                 n: int, percent: int, slack: int = 4) -> DataFrame:
    """Components (node, comp) of the classes, from ``entries`` (token, node, n, pos), a stored table."""
    done = comps = None
    live = entries.withColumn("comp", F.col("node"))
    before = None
    while True:
        by_comp = live.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"))
        todo = by_comp.groupBy("token").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("s"))
        size = todo.agg((F.sum(F.col("m") * F.col("m") - F.col("s")) / 2).alias("pairs"), F.sum("m").alias("rows")).first()
        if not size["pairs"]:
            break
        last = before is not None and (size["pairs"] <= slack * size["rows"] or size["pairs"] > 0.7 * before)
        before = size["pairs"]
        if last:
            # open tokens of each class, at most its prefix: a pair is made at its least common one only
            own = store(spark, live.groupBy("node").agg(F.collect_list("token").alias("open")), "open-tokens")
            wide = store(spark, live.join(if_small(own, 10, "open"), "node"), "open-entries")
            a, b = wide.alias("a"), wide.alias("b")
            met = a.join(b, "token").where("a.node < b.node AND a.comp <> b.comp").where(
                may_link(*({c: F.col(f"{t}.{c}") for c in USED} for t in "ab"), percent)).where(
                F.array_min(F.array_intersect("a.open", "b.open")) == F.col("token"))
            pairs = met.select(F.col("a.node").alias("x"), F.col("b.node").alias("y")).distinct()
        else:
            # the set with the fewest tokens of its own is the likeliest centre of its copies
            own = F.col("n") - F.col("c")
            pivot = store(spark, live.groupBy("token").agg(
                F.min_by("node", own).alias("x"), *[F.min_by(c, own).alias(f"x_{c}") for c in (*USED, "comp")]), "pivots")
            met = live.join(pivot, "token").where("node <> x AND comp <> x_comp").where(
                may_link({c: F.col(c) for c in USED}, {c: F.col(f"x_{c}") for c in USED}, percent))
            pairs = met.select(F.least("x", "node").alias("x"), F.greatest("x", "node").alias("y")).distinct()
        if done is not None:
            pairs = pairs.join(done, ["x", "y"], "left_anti")
        pairs = store(spark, pairs, "pairs")
        close = store(spark, suffix_filter(spark, pairs, parts, percent), "close-pairs")
        found = verify(spark, close, classes, texts, n, percent)
        done = pairs if done is None else done.union(pairs)
        if comps is None or not found.isEmpty():
            comps = components(spark, found, comps)
        if last:
            break
        named = (live.drop("comp").join(if_small(comps, 16), "node", "left")
                 .withColumn("comp", F.coalesce("comp", "node")))
        # the pivot has met its whole bucket
        named = named.join(if_small(pivot.select("token", F.col("x").alias("node")), 16), ["token", "node"], "left_anti")
        named = store(spark, named, "open-entries")
        mixed = store(spark, named.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"))
                      .where("a < b").select("token"), "open-buckets")
        live = store(spark, named.join(if_small(mixed, 8), "token", "left_semi"), "open-entries")
    return comps if comps is not None else spark.createDataFrame([], "node bigint, comp bigint")


def near_duplicates(spark: SparkSession, docs: DataFrame, n: int = N, percent: int = PERCENT,
                    common_bits: int = COMMON_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class_id (smallest doc_id with an equal set) and component_id of every row.

    Null and empty texts have no tokens and link with nothing, and so do rows without an id; they
    are their own class and component. Rows that share an id are judged by their own texts. An
    empty table gives no rows; columns other than the id and the text are not read.
    """
    texts = _texts(docs, id_col, text_col)
    sets = document_sets(spark, texts, n, percent, common_bits)
    classes = store(spark, sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2", "n")
                    .agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id")), "classes")
    kept = sets.join(if_small(classes.select(F.col("node").alias("row")), 8), "row", "left_semi")
    entries = kept.select(F.col("row").alias("node"), "n", "rare", F.posexplode("prefix").alias("pos", "token"))
    shared = store(spark, entries.groupBy("token").count().where("count > 1").select("token"), "shared-tokens")
    entries = store(spark, entries.join(if_small(shared, 8), "token", "left_semi"), "shared-entries")
    entries = with_matchable(spark, entries, percent)
    met = entries.select(F.col("node").alias("row")).distinct()
    parts = store(spark, sets.join(met, "row", "left_semi").select(F.col("row").alias("node"), "n", "parts"), "parts")
    texts = texts.where("doc_id IS NOT NULL")
    comps = link_classes(spark, classes, entries, parts, texts, n, percent)
    named = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = store(spark, named.join(least, "comp").select(
        "k1", "k2", "n", F.col("doc_id").alias("class_id"), "component_id"), "class-components")
    own = sets.select("doc_id", "n", "k1", "k2")
    return own.join(if_small(named, 40), ["k1", "k2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        *[F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c) for c in ("class_id", "component_id")])
