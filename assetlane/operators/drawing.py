"""Replaying the matrix operators of content streams (D3).

A stream is cut into chunks of operators. Each chunk is met once, on its own: its draws, relative to the state it might start
with, and what it does to any matrix stack. Such effects can be merged (an associative operation), so those of a long
stream are merged in levels of ``FAN``, and the starting states are handed down the same levels: a scan in which no
task holds more than ``FAN`` effects. Then the draws of later chunks are seen from the states found. No stream, however
long, is replayed in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlane.session import hand_over, spread

# Fixed value: how deep forms may nest.
MAX_FORM_DEPTH = 8
CHUNK_OPS = 4096
IDENTITY = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]
_SAME = tuple(IDENTITY)
MATRIX = "array<double>"


PLAIN = f"array<{MATRIX}>"
#: summaries merged at once
FAN = 64
#: levels of forms that are met before they are stored
LAZY_LEVELS = 4


def multiply(m: Column, n: Column) -> Column:
    """``m`` applied first, then ``n`` (row vectors)."""
    pair = F.struct(m.cast(MATRIX).alias("m"), n.cast(MATRIX).alias("n"))
    return F.get(F.transform(F.array(pair), lambda v: _product_of(v["m"], v["n"])), 0)


def _product_of(m: Column, n: Column) -> Column:
    a, b, c, d, e, f = (F.get(m, i) for i in range(6))
    g, h, i, j, k, p = (F.get(n, x) for x in range(6))
    return F.array(
        a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j,
        e * g + f * i + k, e * h + f * j + p,
    )


def times(m: tuple, n: tuple) -> tuple:
    """``m`` applied first, then ``n``."""
    a, b, c, d, e, f = m
    g, h, i, j, k, p = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + p)


@dataclass
class Effect:
    """What operators do to any state they start from. ``segs``: net matrix between restores that find nothing
    saved inside; ``stack``: saves left open, relative to the state in which the last segment began."""

    segs: list[tuple]
    stack: list[tuple]

    def then(self, other: Effect) -> Effect:
        """This effect followed by another."""
        done, base, stack = self.segs[:-1], self.segs[-1], list(self.stack)
        now = times(other.segs[0], base)
        for seg in other.segs[1:]:
            if stack:
                base = stack.pop()
            else:
                done.append(now)
                base = tuple(IDENTITY)
            now = times(seg, base)
        return Effect([*done, now], stack + [times(m, base) for m in other.stack])

    def bases(self, ctm: tuple, stack: list[tuple]) -> tuple[list[tuple], list[tuple]]:
        """The state each segment begins from, and what is left of ``stack``. A restore on an empty stack does nothing."""
        found, stack = [ctm], list(stack)
        for seg in self.segs[:-1]:
            found.append(stack.pop() if stack else times(seg, found[-1]))
        return found, stack

    def after(self, bases: list[tuple], left: list[tuple]) -> tuple[tuple, list[tuple]]:
        """The state after it, by :meth:`bases`."""
        return times(self.segs[-1], bases[-1]), left + [times(m, bases[-1]) for m in self.stack]


#: operators by number
SET, SAVE, RESTORE, DRAW, NOTHING = range(5)
_CHUNK = ["doc_id", "owner", "chunk"]


def _in_chunks(ops: DataFrame) -> DataFrame:
    """Operators that may matter, dealt by chunk and in order: ``(doc_id, owner, chunk, op_no, code, args, name)``."""
    op, name = F.col("op"), F.col("name")
    code = F.when((op == "cm") & (F.size("args") >= 6), SET).when(op == "q", SAVE).when(op == "Q", RESTORE).when((op == "Do") & name.isNotNull(), DRAW)
    kept = ops.select(*_CHUNK, F.col("op_no").cast("bigint").alias("op_no"), code.cast("int").alias("code"),
                      F.when(op == "cm", F.col("args").cast(MATRIX)).alias("args"), "name").where("code IS NOT NULL")
    # alike operators compress to few bytes, by which Spark would leave them to few tasks
    parts = int(ops.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return kept.repartition(parts, *_CHUNK).sortWithinPartitions(*_CHUNK, "op_no", "code", "args", "name")


def _operators(ops: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of operators, and the operands of every ``cm``: the last six. A ``cm`` must have finite ones, else it does nothing."""
    codes, args = ops.column("code").to_numpy().copy(), ops.column("args").combine_chunks()
    at = np.flatnonzero(codes == SET)
    operands = np.zeros((len(codes), 6))
    last = args.offsets.to_numpy()[at + 1, None] + np.arange(-6, 0)
    operands[at] = args.values.to_numpy(zero_copy_only=False)[last] if len(at) else 0
    codes[~np.isfinite(operands).all(axis=1)] = NOTHING
    return codes, operands


def _one_by_one(codes: list[int], operands: list, first: bool) -> tuple[list, list, Effect]:
    """The matrices of the draws of a chunk, the segments they lie in, and its effect."""
    done, now, stack, drawn, segs = [], _SAME, [], [], []
    for op, m in zip(codes, operands):
        if op == SET:
            now = times(m, now)
        elif op == SAVE:
            stack.append(now)
        elif op == DRAW:
            drawn.append(now)
            segs.append(len(done))
        elif op == RESTORE and stack:
            now = stack.pop()
        elif op == RESTORE and not first:
            done.append(now)
            now = _SAME
    return drawn, segs, Effect([*done, now], stack)


def _in_step(codes: np.ndarray, operands: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict]:
    """First chunks that begin at ``starts``, one operator of all of them after the other: the matrix at every draw, the
    last one of each chunk, and what chunks leave saved."""
    order = np.argsort(-sizes, kind="stable")
    begin, active = starts[order], np.searchsorted(-sizes[order], -np.arange(int(sizes.max(initial=0))))
    now, top = np.tile(_SAME, (len(order), 1)), np.full(len(order), -1)
    # by operator: the matrix it draws with or saves, and what was saved before it
    at, before = np.empty((len(codes), 6)), np.empty(len(codes), np.int64)
    for step, n in enumerate(active.tolist()):
        here = begin[:n] + step
        code = codes[here]
        some = np.flatnonzero(code == SET)
        now[some] = np.stack(times(operands[here[some]].T, now[some].T), axis=1)
        some = np.flatnonzero((code == SAVE) | (code == DRAW))
        at[here[some]] = now[some]
        some = np.flatnonzero(code == SAVE)
        before[here[some]], top[some] = top[some], here[some]
        some = np.flatnonzero((code == RESTORE) & (top[:n] >= 0))
        now[some], top[some] = at[top[some]], before[top[some]]
    left = {}
    for i in np.flatnonzero(top >= 0).tolist():
        k, saved = int(top[i]), []
        while k >= 0:
            saved.append(tuple(at[k].tolist()))
            k = int(before[k])
        left[int(order[i])] = saved[::-1]
    last = np.empty_like(now)
    last[order] = now
    return at, last, left


#: chunks that are met in step at least, else one by one
IN_STEP = 32


def _chunks_met(ops: pa.Table, starts: np.ndarray) -> pa.Table:
    """Rows of :func:`_replayed` for whole chunks."""
    codes, operands = _operators(ops)
    sizes, later = np.diff(np.append(starts, ops.num_rows)), ops.column("chunk").to_numpy()[starts] > 0
    few = np.sort(sizes)[-IN_STEP] if len(sizes) >= IN_STEP else 0
    alone = later | (sizes > few)
    together = np.flatnonzero(~alone)
    at, last, left = _in_step(codes, operands, starts[together], sizes[together])
    segs, now, effects = np.zeros(len(codes), np.int32), np.empty((len(starts), 6)), {}
    now[together] = last
    stacks = {int(together[i]): saved for i, saved in left.items()}
    for i in np.flatnonzero(alone).tolist():
        lo, hi = starts[i], starts[i] + sizes[i]
        drawn, seg, effect = _one_by_one(codes[lo:hi].tolist(), operands[lo:hi].tolist(), not later[i])
        places = lo + np.flatnonzero(codes[lo:hi] == DRAW)
        if drawn:
            at[places], segs[places] = drawn, seg
        now[i], stacks[i] = effect.segs[-1], effect.stack
        if later[i]:
            effects[i] = effect.segs
    draws, n = np.flatnonzero(codes == DRAW), len(starts)
    rows = ops.select([*_CHUNK, "op_no", "name"]).take(pa.array(np.concatenate([draws, starts])))
    matrices = np.concatenate([at[draws], now]).T
    lists = lambda of: pa.concat_arrays([pa.nulls(len(draws), _LIST), pa.array([of.get(i) or None for i in range(n)], _LIST)])
    seg = pa.array(np.concatenate([segs[draws], np.full(n, -1, np.int32)]))
    return pa.table([*rows.columns, seg, *(pa.array(v) for v in matrices), lists(effects), lists(stacks)],
                    names=[*rows.column_names, "seg", *"abcdef", "segs", "stack"])


def _replayed(ops: DataFrame) -> DataFrame:
    """Every operator met once, in chunks as they lie: one row a draw and one a chunk.

    The matrix (``a`` to ``f``) of a draw is that of a first chunk, or relative to the state in which segment ``seg`` of a later
    chunk begins. The row of a chunk has ``seg`` -1 and its effect: ``stack``, null if empty, and ``segs``, null if there is one,
    which is its matrix. A task holds one Arrow batch and a chunk.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the chunk that may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            if rows.num_rows:
                rows = rows.combine_chunks()
                starts = _starts(rows)
                held = rows.slice(starts[-1])
                if len(starts) > 1:
                    yield from _chunks_met(rows.slice(0, starts[-1]).combine_chunks(), starts[:-1]).combine_chunks().to_batches()
        if held is not None and held.num_rows:
            yield from _chunks_met(held.combine_chunks(), np.zeros(1, np.int64)).combine_chunks().to_batches()

    kind = ops.schema["doc_id"].dataType.simpleString()
    return _in_chunks(ops).mapInArrow(
        run, f"doc_id {kind}, owner string, chunk bigint, op_no bigint, name string, seg int, "
        f"{', '.join(f'{c} double' for c in 'abcdef')}, segs {PLAIN}, stack {PLAIN}")


def _starts(keys: pa.Table) -> np.ndarray:
    """Where the rows of another chunk begin."""
    new = np.zeros(keys.num_rows - 1, bool)
    for c in _CHUNK:
        number = keys.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        new |= number[1:] != number[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1])


_LIST = pa.list_(pa.list_(pa.float64()))


def _arrays(found: list[Effect]) -> list[pa.Array]:
    return [pa.array([e.segs for e in found], _LIST), pa.array([e.stack for e in found], _LIST)]


def _in_order(group: pa.Table) -> tuple[pa.Table, list[Effect]]:
    group = group.sort_by("chunk")
    lists = zip(group.column("segs").to_pylist(), group.column("stack").to_pylist())
    return group, [Effect([tuple(m) for m in a], [tuple(m) for m in b]) for a, b in lists]


def _merged(group: pa.Table) -> pa.Table:
    """One effect for up to ``FAN`` neighbours."""
    group, found = _in_order(group)
    whole = found[0]
    for e in found[1:]:
        whole = whole.then(e)
    first = group.slice(0, 1)
    return pa.table([first.column("doc_id"), first.column("owner"), first.column("up"), *_arrays([whole])],
                    names=["doc_id", "owner", "chunk", "segs", "stack"])


def _started(group: pa.Table) -> pa.Table:
    """The state each of up to ``FAN`` neighbours starts from and those its segments begin from, given that of the first."""
    group, found = _in_order(group)
    ctm = tuple(group.column("ctm")[0].as_py() or IDENTITY)
    stack = [tuple(m) for m in group.column("saved")[0].as_py() or ()]
    states = []
    for e in found:
        bases, left = e.bases(ctm, stack)
        states.append((ctm, stack, bases))
        ctm, stack = e.after(bases, left)
    ctms, stacks, bases = zip(*states)
    return pa.table([*(group.column(c) for c in _CHUNK), pa.array(ctms, pa.list_(pa.float64())), pa.array(stacks, _LIST), pa.array(bases, _LIST)],
                    names=[*_CHUNK, "ctm", "stack", "bases"])


def starting_states(chunks: DataFrame, fan: int = FAN) -> DataFrame:
    """(doc_id, owner, chunk, ctm, stack): the state every chunk of the streams starts from; ``chunks`` hold their ``ops``."""
    ops = chunks.select(*_CHUNK, F.explode("ops").alias("o")).select(*_CHUNK, "o.op_no", "o.op", F.col("o.m").alias("args"), "o.name")
    return _states(hand_over(_replayed(ops).where("seg < 0"), "effects"), fan).drop("bases")


def _states(effects: DataFrame, fan: int = FAN) -> DataFrame:
    """The state every chunk starts from, and those its segments begin from (``bases``), by stored effects."""
    kind = effects.schema["doc_id"].dataType.simpleString()
    up = F.floor(F.col("chunk") / F.lit(fan)).cast("bigint").alias("up")
    levels = [effects.select(*_CHUNK, F.coalesce("segs", F.array(F.array(*"abcdef"))).alias("segs"), F.coalesce("stack", F.array().cast(PLAIN)).alias("stack"))]
    most = levels[0].agg(F.max("chunk").alias("n")).first()["n"] or 0
    while most >= fan:
        levels.append(hand_over(levels[-1].select("*", up).groupBy("doc_id", "owner", "up").applyInArrow(
            _merged, f"doc_id {kind}, owner string, chunk bigint, segs {PLAIN}, stack {PLAIN}"), "effects"))
        most //= fan
    above = None
    for level in reversed(levels):
        rows = level.select("*", up)
        if above is None:
            rows = rows.withColumns({"ctm": F.lit(None).cast(MATRIX), "saved": F.lit(None).cast(PLAIN)})
        else:
            rows = rows.join(spread(above.select("doc_id", "owner", F.col("chunk").alias("up"), "ctm", F.col("stack").alias("saved"))),
                             ["doc_id", "owner", "up"])
        above = rows.groupBy("doc_id", "owner", "up").applyInArrow(
            _started, f"doc_id {kind}, owner string, chunk bigint, ctm {MATRIX}, stack {PLAIN}, bases {PLAIN}")
    return above


def stream_draws(ops: DataFrame, chunk_ops: int = CHUNK_OPS) -> DataFrame:
    """Draws of every stream from the identity matrix: ``(doc_id, owner, op_no, name, m)``.

    ``ops`` holds (doc_id, owner, op_no, op, args array<double>, name) with op_no from 0. Operators are shuffled and met
    once; the draws of later chunks are then seen from the state in which their segment begins.
    """
    chunk = F.floor(F.col("op_no") / F.lit(chunk_ops)).cast("bigint")
    stored = hand_over(_replayed(ops.withColumn("chunk", F.coalesce(chunk, F.lit(0)))), "draws")
    drawn, effects = stored.where("seg >= 0").withColumn("m", F.array(*"abcdef")), stored.where("seg < 0")
    names = ["doc_id", "owner", "op_no", "name"]
    long = effects.where("chunk > 0").select("doc_id", "owner").distinct()
    if long.isEmpty():
        return drawn.select(*names, "m")
    bases = _states(hand_over(effects.join(spread(long), ["doc_id", "owner"], "left_semi"), "effects")).where("chunk > 0").select(
        *_CHUNK, F.posexplode("bases").alias("seg", "base"))
    later = drawn.where("chunk > 0").join(spread(bases), [*_CHUNK, "seg"])
    return drawn.where("chunk <= 0").select(*names, "m").unionByName(later.select(*names, _product_of(F.col("m"), F.col("base")).alias("m")))


def _followed(
    page_ops: DataFrame, form_ops: DataFrame, xobjects: DataFrame, chunk_ops: int
) -> tuple[DataFrame, DataFrame]:
    """Draws of pages and of forms (``of`` being their number), each with what its name stands for; forms are stored."""
    cols = ["doc_id", "owner", "op_no", "op", "args", "name"]
    named = xobjects.select("doc_id", "owner", "name", "kind", "ref", F.col("matrix").cast(MATRIX).alias("matrix"))

    def side(ops: DataFrame, letter: str, number: str) -> DataFrame:
        streams = ops.withColumn("owner", F.concat(F.lit(letter), F.col(number).cast("string"))).select(*cols)
        met = stream_draws(streams, chunk_ops).join(spread(named), ["doc_id", "owner", "name"])
        return met.select("doc_id", F.substring("owner", 2, 20).cast("bigint").alias("of"), "name", "kind", "ref", "matrix", "m")

    return side(page_ops, "p", "page"), hand_over(side(form_ops, "f", "form"), "form-draws")


def _edges(draws: DataFrame) -> DataFrame:
    """Forms that streams draw, with the matrix a form starts from."""
    base = F.when(F.col("matrix").isNotNull(), _product_of(F.col("matrix"), F.col("m"))).otherwise(F.col("m"))
    return draws.where(F.col("kind") == "form").select("doc_id", "of", F.col("ref").cast("bigint").alias("inner"), base.alias("base"))


def _through(edges: DataFrame, reached: DataFrame, again: bool) -> DataFrame:
    """Draws of ``reached`` forms seen from the streams that draw those forms, unless the stream is one of the forms
    in between and must not come ``again``."""
    inner = reached.select(
        "doc_id", F.col("of").alias("inner"), "name", "ref", F.col("m").alias("rel"), "path")
    met = edges.join(spread(inner), ["doc_id", "inner"])
    if not again:
        met = met.where(~F.array_contains("path", F.col("of")))
    path = F.array_append("path", F.col("of")) if not again else F.col("path")
    return met.select("doc_id", "of", "name", "ref", _product_of(F.col("rel"), F.col("base")).alias("m"), path.alias("path"))


def ctm_walk(
    page_ops: DataFrame, form_ops: DataFrame, xobjects: DataFrame, max_depth: int | None = MAX_FORM_DEPTH,
    chunk_ops: int = CHUNK_OPS,
) -> DataFrame:
    """D3: image draws ``(doc_id, page, name, ref, a, b, c, d, e, f)`` with forms followed.

    ``page_ops(doc_id, page, ...)`` and ``form_ops(doc_id, form, ...)`` hold the operators;
    ``xobjects(doc_id, owner, name, kind, ref, matrix)`` resolves names, ``owner`` being
    ``p<page>`` or ``f<form>``. Each form is replayed once and stored; what forms draw through forms
    is added level by level on that table until a level is empty or ``max_depth`` is reached, and pages meet the
    finished table once. ``max_depth=None`` follows forms to any depth, but none inside itself. What is not
    followed is listed by :func:`cut_draws`.
    """
    drawn, inside = _followed(page_ops, form_ops, xobjects, chunk_ops)
    again = max_depth is not None

    def images(draws: DataFrame) -> DataFrame:
        path = F.array() if again else F.array("of")
        return draws.where(F.col("kind") == "image").select(
            "doc_id", "of", "name", "ref", "m", path.cast("array<bigint>").alias("path"))

    nested, level = _edges(inside), images(inside)
    reached, depth = level, 1
    while max_depth is None or depth < max_depth:
        level = hand_over(_through(nested, level, again), "form-level")
        if level.isEmpty():
            break
        reached, depth = reached.unionByName(level), depth + 1
    found = images(drawn).unionByName(_through(_edges(drawn), reached, True))
    return found.select(
        "doc_id", F.col("of").cast("int").alias("page"), "name", "ref",
        *[F.get(F.col("m"), i).alias(c) for i, c in enumerate("abcdef")],
    )


@dataclass(frozen=True)
class FormDraws:
    """Which forms streams draw, each once, by number: ``pages(doc_id, page, inner)`` and ``forms(doc_id, form, inner)``."""

    pages: DataFrame
    forms: DataFrame


def form_draws(page_ops: DataFrame, form_ops: DataFrame, xobjects: DataFrame) -> FormDraws:
    """The forms that streams draw, stored. Where a form is drawn depends on no matrix, so no stream is replayed."""
    def drawn(ops: DataFrame, side: str) -> DataFrame:
        number = F.substring("owner", 2, 20).try_cast("bigint")
        named = xobjects.where((F.col("kind") == "form") & (F.col("owner") == F.concat(F.lit(side[0]), number.cast("string")))).select(
            "doc_id", number.alias(side), "name", F.col("ref").cast("bigint").alias("inner"))
        met = ops.where((F.col("op") == "Do") & F.col("name").isNotNull()).select("doc_id", F.col(side).cast("bigint"), "name").distinct()
        return met.join(spread(named), ["doc_id", side, "name"]).select("doc_id", side, "inner").distinct()

    return FormDraws(hand_over(drawn(page_ops, "page"), "page-forms"), hand_over(drawn(form_ops, "form"), "form-edges"))


def cut_draws(
    page_ops: DataFrame, form_ops: DataFrame, xobjects: DataFrame, max_depth: int | None = MAX_FORM_DEPTH,
) -> DataFrame:
    """D3: ``(doc_id, page, form, inner)``: form draws that ``ctm_walk`` does not follow, each once.

    ``form`` is followed on that page and draws ``inner``, which would lie beyond ``max_depth``; with ``max_depth=None``
    those are the draws of a form inside itself. ``form`` is null where a page's own form is cut.
    """
    return cut_among(form_draws(page_ops, form_ops, xobjects), max_depth)


def cut_among(draws: FormDraws, max_depth: int | None = MAX_FORM_DEPTH) -> DataFrame:
    """``cut_draws`` of stored form draws, for more than one depth."""
    found = _cut_inside(draws) if max_depth is None else _cut_below(draws, max_depth)
    return found.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("page", "form", "inner")]).distinct()


def _inside(level: DataFrame, draws: FormDraws, first: bool) -> DataFrame:
    """What the forms drawn on a level draw; dealt as the join asks for, so that a level is shuffled once."""
    keep = [c for c in level.columns if c == "path"]
    at = level.select("doc_id", "page", F.col("inner").alias("form"), *keep).repartition("doc_id", "form")
    return (at if first else at.distinct()).join(spread(draws.forms), ["doc_id", "form"]).select("doc_id", "page", "form", "inner", *keep)


def _cut_below(draws: FormDraws, max_depth: int) -> DataFrame:
    """Draws by the forms that lie ``max_depth`` deep."""
    level = draws.pages.select("doc_id", "page", F.lit(None).cast("bigint").alias("form"), "inner")
    for depth in range(max_depth):
        level = _inside(level, draws, depth == 0)
        if depth % LAZY_LEVELS == LAZY_LEVELS - 1 and depth < max_depth - 1:
            level = hand_over(level, "form-level")
            if level.isEmpty():
                break
    return level


def _cut_inside(draws: FormDraws) -> DataFrame:
    """Draws of a form by itself or by a form within it, along every way that comes to no form twice."""
    level, out = draws.pages.select("doc_id", "page", "inner", F.array("inner").alias("path")), None
    while True:
        met = _inside(level, draws, out is None).withColumn("again", F.array_contains("path", F.col("inner")))
        step = hand_over(met, "form-level")
        cut = step.where("again").select("doc_id", "page", "form", "inner")
        out = cut if out is None else out.unionByName(cut)
        if step.isEmpty():
            return out
        level = step.where("NOT again").select("doc_id", "page", "inner", F.array_append("path", F.col("inner")).alias("path"))
