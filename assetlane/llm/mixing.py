"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). The token mass of the cells is raked to the
target marginals one dimension after the other until all hold; the ratio of raked to present mass,
scaled to the token budget, is each document's probability of being sampled. A probability stops at
one, and what that leaves out is raked over the other cells again. Targets that no sample of the
budget can meet are fitted and reported.

A dimension lists its target values; every other value, null included, is one cell ``*`` that gets
the rest of the mass. So there are at most (listed + 1) cells a dimension, whatever the corpus, and
raking runs on the driver over one small table that Spark has summed over all documents. Draws
are a keyed hash of the id: the same document is drawn alike on every run and in every task.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assetlane.llm.tables import small_batches
from assetlane.llm.words import SPACE, chunks

OTHER = "*"
_FORM = "struct<words:bigint,chars:bigint,symbols:bigint,figures:bigint,feeds:bigint>"


def _marks(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOLS, _FIGURES, _FEEDS, _CHARS = _marks(b"#*$%&|<>"), _marks(b"0123456789"), _marks(b"\n"), ~_marks(bytes(range(0x80, 0xC0)))


def form_counts(texts: list[bytes]) -> np.ndarray:
    """Words, characters, symbols, figures and line feeds of each text, one row a text."""
    offset = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    inside = ~SPACE[buf]
    begins = inside & np.concatenate([[True], ~inside[:-1]])

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offset[1:]] - total[offset[:-1]]

    counts = [per_text(x) for x in (begins, _CHARS[buf], _SYMBOLS[buf], _FIGURES[buf], _FEEDS[buf])]
    counts[1] -= 1  # the space after each text
    return np.stack(counts, axis=1)


def with_form(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``+n_tokens`` (words) and ``+topic``, a plain topic by form: markup, figures, lines or prose.

    One vectorised pass over the texts. A null text has no tokens and no topic. Columns of these
    names are replaced.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(_FORM)
    def counted(column: pd.Series) -> pd.DataFrame:
        texts = [t or b"" for t in column]
        parts = [form_counts(texts[lo:hi]) for lo, hi in chunks(texts)]
        table = np.concatenate(parts) if parts else np.zeros((0, 5), dtype=np.int64)
        return pd.DataFrame(table, columns=["words", "chars", "symbols", "figures", "feeds"])

    out = docs.withColumn("__form", counted(F.col(text_col).cast("binary")))
    n = {k: F.col(f"__form.{k}") for k in ("words", "chars", "symbols", "figures", "feeds")}
    topic = (F.when(F.col(text_col).isNull(), F.lit(None).cast("string")).when(20 * n["symbols"] > n["chars"], "markup")
             .when(50 * n["figures"] > n["chars"], "figures").when(150 * n["feeds"] > n["chars"], "lines").otherwise("prose"))
    return out.withColumns({"n_tokens": n["words"], "topic": topic}).drop("__form")


def rake(mass: np.ndarray, targets: list[np.ndarray], rounds: int = 1000, tolerance: float = 1e-12) -> np.ndarray:
    """Mass scaled so that its sum over all axes but d is ``targets[d]``.

    A target where there is no mass cannot be met; its share goes to the others in proportion.
    """
    out = mass / mass.sum()
    axes = [tuple(a for a in range(mass.ndim) if a != d) for d in range(mass.ndim)]
    goals = []
    for d, t in enumerate(targets):
        t = np.where(out.sum(axis=axes[d]) > 0, t, 0)
        goals.append(t / t.sum() if t.sum() else out.sum(axis=axes[d]))
    for _ in range(rounds):
        worst = 0.0
        for d, goal in enumerate(goals):
            now = out.sum(axis=axes[d])
            worst = max(worst, float(np.abs(now - goal).max()))
            out = out * np.divide(goal, now, out=np.zeros_like(now), where=now > 0).reshape(
                [-1 if a == d else 1 for a in range(mass.ndim)])
        if worst < tolerance:
            break
    return out


def capped(mass: np.ndarray, goals: list[np.ndarray], budget: float, rounds: int = 1000) -> tuple[np.ndarray, float]:
    """Tokens of each cell, at most ``mass``, with marginals ``goals`` times ``budget``; and how far,
    as a share of the budget, the worst marginal is from its goal.

    Projects onto one dimension after the other: the cells of a value grow by one factor, each up to
    its mass. That meets all goals if any tokens within the mass do.
    """
    want = mass * (budget / mass.sum())
    worst = before = 1.0
    for k in range(rounds):
        for d, goal in enumerate(goals):
            cells, room = np.moveaxis(want, d, 0), np.moveaxis(mass, d, 0)
            for v, g in enumerate(goal * budget):
                x, m = cells[v].ravel(), room[v].ravel()
                full = np.divide(m, x, out=np.full_like(x, np.inf), where=x > 0)
                if g >= m.sum() * (1 - 1e-12):
                    x = m
                elif x.sum() > 0:
                    order = np.argsort(full)
                    held = np.cumsum(np.concatenate([[0.0], m[order]]))[:-1]
                    free = np.cumsum(x[order][::-1])[::-1]
                    factor = np.divide(g - held, free, out=np.full_like(x, np.inf), where=free > 0)
                    fits = factor <= full[order] * (1 + 1e-12)
                    x = np.minimum(m, x * factor[fits.argmax()]) if fits.any() else m
                cells[v] = x.reshape(cells[v].shape)
        worst = max(float(np.abs(marginal(want, d) / budget - g).max()) for d, g in enumerate(goals))
        if worst < 1e-9 or (k % 100 == 99 and worst > 0.99 * before):
            break
        before = worst if k % 100 == 99 else before
    return want, worst


def marginal(mass: np.ndarray, d: int) -> np.ndarray:
    return mass.sum(axis=tuple(a for a in range(mass.ndim) if a != d))


def gap(want: np.ndarray, targets: list[np.ndarray]) -> float:
    """How far the worst marginal of ``want`` is from its target, both as shares."""
    total = want.sum() or 1.0
    return max(float(np.abs(marginal(want, d) / total - t / t.sum()).max()) for d, t in enumerate(targets))


def nearest(goal: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Shares of one dimension that stay below ``room`` and else keep the proportions of ``goal``."""
    out, open_ = np.zeros_like(goal), np.ones(len(goal), dtype=bool)
    for _ in range(len(goal) + 1):
        left = max(0.0, 1 - out[~open_].sum())
        shape = np.where(goal[open_].sum() > 0, goal, room) * open_
        out[open_] = left * shape[open_] / shape.sum() if shape.sum() > 0 else 0
        over = open_ & (out > room)
        if not over.any():
            break
        out[over], open_ = room[over], open_ & ~over
    return out


#: a marginal counts as met when it is this near its goal, as a share of the budget
TOLERANCE = 1e-3


def fit_targets(mass: np.ndarray, targets: list[np.ndarray], budget: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Tokens of each cell that hold ``budget``, and the goals they meet to ``TOLERANCE``.

    For targets that the corpus cannot hold at this budget. Of each dimension the values that run out
    are taken whole and the others keep the proportions of their targets, so a value to be held down
    grows by no more than the others. Dimensions that cannot be met together after that move towards
    the corpus's own shares by the least step that makes them (at the full step every cell is sampled
    alike, which always holds).
    """
    near = [nearest(t / t.sum(), marginal(mass, d) / budget) for d, t in enumerate(targets)]
    own = [marginal(mass, d) / mass.sum() for d in range(mass.ndim)]
    want, worst = capped(mass, near, budget)
    if worst <= TOLERANCE:
        return want, near
    low, high, best = 0.0, 1.0, (mass * (budget / mass.sum()), own)
    for _ in range(12):
        step = (low + high) / 2
        goals = [(1 - step) * a + step * b for a, b in zip(near, own)]
        want, worst = capped(mass, goals, budget)
        if worst <= TOLERANCE:
            high, best = step, (want, goals)
        else:
            low = step
    return best


def largest_share(mass: np.ndarray, targets: list[np.ndarray]) -> float:
    """The largest part of all tokens, to three digits, at which the targets hold to ``TOLERANCE``."""
    goals = [t / t.sum() for t in targets]
    low, high = 0.0, min([1.0, *(float((marginal(mass, d)[g > 0] / g[g > 0]).min() / mass.sum()) for d, g in enumerate(goals))])
    if high > 0 and capped(mass, goals, high * mass.sum())[1] <= TOLERANCE:
        return high
    while high - low > 1e-3 * high:
        mid = (low + high) / 2
        low, high = (mid, high) if capped(mass, goals, mid * mass.sum())[1] <= TOLERANCE else (low, mid)
    return low


def probabilities(mass: np.ndarray, targets: list[np.ndarray], budget: float, rounds: int = 200) -> np.ndarray:
    """Sampling probability of each cell: raked to the targets and to ``budget`` tokens in all.

    The budget holds. Targets that the cells cannot hold at this budget are fitted (``fit_targets``).
    """
    if not mass.sum() > 0:
        return np.zeros_like(mass)
    budget = min(budget, float(mass.sum()))
    want = mass
    for _ in range(rounds):
        want = rake(np.where(mass > 0, want, 0), targets) * budget
        if (want <= mass * (1 + 1e-9)).all():
            break
        want = np.minimum(want, mass)
    want = np.minimum(want, mass)
    if budget > 0 and gap(want, targets) > TOLERANCE:
        want = np.minimum(fit_targets(mass, targets, budget)[0], mass)
    # rounding of the fit, at most its tolerance
    spare, lack = (mass - want).sum(), budget - want.sum()
    want = want + (mass - want) * min(1.0, lack / spare) if lack > 0 and spare > 0 else want * (budget / want.sum() if want.sum() > 0 else 0)
    return np.divide(want, mass, out=np.zeros_like(mass), where=mass > 0).clip(0, 1)


def mix_sources(spark: SparkSession, docs: DataFrame, targets: dict[str, dict[str, float]], share: float,
                tokens: str = "n_tokens", seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with weight, probability and sampled (columns of these names are replaced).

    ``tokens`` names the column that counts a row's tokens, such as ``with_form`` adds. ``targets`` maps a column of ``docs`` to shares of its values; what they leave of 1 goes to all
    other values together. ``share`` is the part of all tokens to sample. A null count is
    none; a cell without tokens is sampled with probability 0 unless every document is wanted.
    Null ids draw by their text; repeated rows draw alike. An empty table gives no rows.

    ``share`` holds. Targets that the corpus cannot hold at it are fitted (``fit_targets``), with a
    warning that names every marginal off its target and the largest share at which all would hold;
    ``mixing_report`` gives the marginals as a table.
    """
    names = list(targets)
    listed = {d: [*t, OTHER] for d, t in targets.items()}
    cell = [F.coalesce(F.when(F.col(d).isin(*t), F.col(d)), F.lit(OTHER)) for d, t in targets.items()]
    counted = docs.withColumns({f"__cell{i}": c for i, c in enumerate(cell)})
    keys = [f"__cell{i}" for i in range(len(names))]
    sums = counted.groupBy(*keys).agg(F.sum(F.coalesce(tokens, F.lit(0))).alias("n")).collect()  # bounded by the targets
    mass = np.zeros([len(listed[d]) for d in names])
    for r in sums:
        mass[tuple(listed[d].index(r[k]) for d, k in zip(names, keys))] = r["n"]
    goals = [np.array([*targets[d].values(), max(0.0, 1 - sum(targets[d].values()))]) for d in names]
    p = probabilities(mass, goals, share * float(mass.sum()))
    if (p * mass).sum() > 0 and gap(p * mass, goals) > TOLERANCE:
        taken = p * mass / (p * mass).sum()
        off = [f"{n} {v} {t:.4f}: {r:.4f}" for d, n in enumerate(names) for v, t, r in
               zip(listed[n], goals[d] / goals[d].sum(), marginal(taken, d)) if abs(t - r) > TOLERANCE]
        warnings.warn(f"mixing: the corpus cannot hold its targets at share {share}; target: reached are {', '.join(off)}; "
                      f"all hold up to share {largest_share(mass, goals):.4f}", stacklevel=2)
    chance = F.lit(1.0 if share >= 1 else 0.0)
    for r in sums:
        at = tuple(listed[d].index(r[k]) for d, k in zip(names, keys))
        if mass[at] > 0:
            here = F.lit(True)
            for k in keys:
                here = here & (F.col(k) == r[k])
            chance = F.when(here, F.lit(float(p[at]))).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col)), F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return (counted.withColumn("probability", chance)
            .withColumn("weight", F.when(F.col("probability") > 0, 1 / F.col("probability")))
            .withColumn("sampled", draw < F.col("probability")).drop(*keys))


def mixing_report(mixed: DataFrame, targets: dict[str, dict[str, float]], tokens: str = "n_tokens") -> DataFrame:
    """Target against reached marginals of a result of ``mix_sources``, one row a dimension and value.

    ``present`` is the share of all tokens, ``expected`` that of the sample by its probabilities and
    ``drawn`` that of the documents drawn; ``met`` tells whether ``expected`` is near the target.
    """
    n = F.coalesce(tokens, F.lit(0)).cast("double")
    row = F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.when(F.col(d).isin(*t), F.col(d)), F.lit(OTHER)).alias("value"))
                    for d, t in targets.items()])
    weights = {"present": n, "expected": n * F.col("probability"), "drawn": F.when(F.col("sampled"), n).otherwise(0.0)}
    sums = (mixed.select(F.explode(row).alias("at"), *[w.alias(k) for k, w in weights.items()]).groupBy("at.dimension", "at.value")
            .agg(*[F.sum(k).alias(k) for k in weights]).collect())  # bounded by the targets
    found = {(r["dimension"], r["value"]): r for r in sums}
    out = []
    for d, t in targets.items():
        goals = {**t, OTHER: max(0.0, 1 - sum(t.values()))}
        whole = {k: sum(r[k] for r in sums if r["dimension"] == d) or 1.0 for k in weights}
        for v, goal in goals.items():
            r = found.get((d, v))
            parts = [r[k] / whole[k] if r else 0.0 for k in weights]
            goal /= sum(goals.values())
            out.append((d, v, goal, *parts, abs(parts[1] - goal) <= TOLERANCE))
    return mixed.sparkSession.createDataFrame(
        out, "dimension string, value string, target double, present double, expected double, drawn double, met boolean")
