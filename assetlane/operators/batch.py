"""Batch runs: progress, archive names and manifest, resets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assetlane.functions.numbers import dbl, js_round
from assetlane.functions.paths import basename, folder_of, safe_path
from assetlane.functions.savings import saved_fraction
from assetlane.plans.ordered import running_position, running_sum

# An extension, and a " (n)" suffix as the naming rule writes it (n from 2).
_EXTENSION = r"(?s)(\.[^./\\]*)\z"
_SUFFIX = r"(?s)^(.*) \(([2-9]|[1-9][0-9]{1,17})\)\z"


def batch_progress(items: DataFrame, empty_fraction: float = 1.0) -> DataFrame:
    """A1: counts by status, bytes over done items, settled fraction and whole percent saved."""
    status = F.col("status")
    done = status == "done"
    runs = items.groupBy("run_id").agg(
        F.count("status").alias("total"),
        F.count_if(done).alias("done"),
        F.count_if(status == "error").alias("errored"),
        F.count_if(status == "processing").alias("processing"),
        F.coalesce(F.sum(F.when(done, F.col("src_size"))), F.lit(0)).cast("bigint").alias("bytes_in"),
        F.coalesce(F.sum(F.when(done, F.col("out_size"))), F.lit(0)).cast("bigint").alias("bytes_out"),
    )
    settled = (F.col("done") + F.col("errored")).cast("double")
    total = F.col("total").cast("double")
    return runs.withColumns(
        {
            "pending": F.greatest(
                F.lit(0).cast("bigint"),
                F.col("total") - F.col("done") - F.col("errored") - F.col("processing"),
            ),
            "fraction": F.when(F.col("total") == 0, dbl(empty_fraction)).otherwise(
                settled / F.nullif(total, dbl(0))
            ),
            "saved_pct": js_round(
                saved_fraction(F.col("bytes_in"), F.col("bytes_out")) * dbl(100)
            ),
        }
    )


def entry_source(name: Column, out_name: Column) -> Column:
    """Archive path before name clashes: source folder plus output name, sanitised."""
    folder, base = folder_of(name), basename(out_name)
    raw = F.when(folder == "", base).otherwise(F.concat(folder, F.lit("/"), base))
    return F.coalesce(F.nullif(safe_path(raw), F.lit("")), base)


def _extension(path: Column) -> Column:
    return F.regexp_extract(path, _EXTENSION, 1)


def _stem(path: Column) -> Column:
    return F.substring(path, F.lit(1), F.length(path) - F.length(_extension(path)))


def _suffixed(path: Column, n: Column) -> Column:
    return F.concat(_stem(path), F.lit(" ("), n.cast("string"), F.lit(")"), _extension(path))


def _settle_family(_key, rows: pd.DataFrame) -> pd.DataFrame:
    """Who holds each clashing name of one family; parents before children.

    ``link`` rows are (parent, path, n, seq): the natural name ``path`` reads like copy ``n`` of
    ``parent`` and first comes at ``seq``. ``item`` rows give the arrival of selected copies.
    """
    items = rows[rows.kind == "item"]
    arrival = {(p, int(k)): s for p, k, s in zip(items.path, items.pos, items.seq, strict=True)}
    links = rows[rows.kind == "link"].sort_values(["depth", "n"])
    count = {p: int(c) for p, c in zip(links.parent, links.parent_count, strict=True)}
    names = set(links.parent) | set(links.path)
    lost: dict[str, bool] = dict.fromkeys(names, False)
    cuts: dict[str, list[int]] = {p: [] for p in names}
    for parent, group in links.groupby("parent", sort=False):
        shift = 0 if lost[parent] else 1
        waiting = count[parent] - shift
        for path, n, first in zip(group.path, group.n, group.seq, strict=True):
            nth = int(n) - 1 - len(cuts[parent])
            if nth > waiting:
                break
            if first < arrival[(parent, nth + shift)]:
                cuts[parent].append(nth)
            else:
                lost[path] = True
    order = sorted(names)
    return pd.DataFrame(
        {
            "run_id": rows.run_id.iloc[0], "path": order, "lost": [lost[p] for p in order],
            "cuts": [cuts[p] for p in order],
        }
    )


def _links(names: DataFrame, chunk_rows: int) -> DataFrame:
    """Natural names that read like copy ``n`` of another and that a copy can reach.

    ``rank`` names of a parent have a smaller ``n``, and each lets the copies skip one number at most.
    So name ``n`` needs ``n - 1 - rank`` waiting copies; all items of the parent wait only if it can
    lose its own name, else all but one. Names beyond never clash, nor do those of larger ``n``.
    """
    stem, ext = _stem(F.col("path")), _extension(F.col("path"))
    likely = names.where(stem.rlike(_SUFFIX)).select(
        "run_id", "path", "seq", F.regexp_extract(stem, _SUFFIX, 2).cast("bigint").alias("n"),
        F.concat(F.regexp_extract(stem, _SUFFIX, 1), ext).alias("parent"),
        F.concat(F.regexp_replace(stem, r"( \(([2-9]|[1-9][0-9]{1,17})\))+\z", ""), ext).alias("root"),
        F.length(stem).alias("depth"),
    )
    keys = ["run_id", "parent"]
    parents = names.select("run_id", F.col("path").alias("parent"), F.col("count").alias("parent_count"))
    waiting = F.col("parent_count") - F.when(_stem(F.col("parent")).rlike(_SUFFIX), 0).otherwise(1)
    linked = likely.join(parents.where(waiting > 0), keys)
    size = linked.groupBy(*keys).agg(F.count(F.lit(1)).alias("__links"))
    near = linked.join(size, keys).where(F.col("n") - 1 <= waiting + F.col("__links")).drop("__links")
    ranked = running_position(near, keys, [F.col("n")], "rank", chunk_rows)
    return ranked.withColumn("rank", F.col("rank") - 1).where(F.col("n") - 1 - F.col("rank") <= waiting)


def archive_paths(items: DataFrame, path: str = "path", chunk_rows: int = 1_000_000) -> DataFrame:
    """``+entry_path`` within each ``run_id``, in ``seq`` order.

    The first of several equal paths keeps it, later ones take `` (2)``, `` (3)``... and skip names
    that are taken. Copies are numbered by a chunked running count. Where a natural name reads like
    a copy of another ("a (2).png" beside "a.png"), who gets it depends on arrival. Only the clashing
    names and the few copies that could reach them are settled together, per family of names; the
    copies themselves, however many, are placed by arithmetic.
    """
    rows = items.withColumnRenamed(path, "__path") if path != "path" else items
    rows = rows.withColumn("path", F.col("__path")) if path != "path" else rows
    keys = ["run_id", "path"]
    placed = running_position(rows, keys, [F.col("seq")], "__pos", chunk_rows)

    names = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.min("seq").alias("seq"))
    links = _links(names, chunk_rows)

    first = F.greatest(F.lit(1).cast("bigint"), F.col("n") - 1 - F.col("rank"))
    last = F.least(F.col("parent_count"), F.col("n"))
    reach = links.where(first <= last).select(
        "run_id", F.col("parent").alias("path"), "root", F.explode(F.sequence(first, last)).alias("__pos")
    ).distinct()
    none = F.lit(None)
    item_rows = reach.join(placed.select(*keys, "__pos", "seq"), [*keys, "__pos"]).select(
        "run_id", "root", F.lit("item").alias("kind"), "path", none.cast("string").alias("parent"),
        none.cast("bigint").alias("parent_count"), none.cast("bigint").alias("n"), "seq",
        F.col("__pos").alias("pos"), none.cast("int").alias("depth"),
    )
    link_rows = links.select(
        "run_id", "root", F.lit("link").alias("kind"), "path", "parent", "parent_count", "n", "seq",
        none.cast("bigint").alias("pos"), "depth",
    )
    run_type = items.schema["run_id"].dataType.simpleString()
    settled = link_rows.unionByName(item_rows).groupBy("run_id", "root").applyInPandas(
        _settle_family, f"run_id {run_type}, path string, lost boolean, cuts array<bigint>"
    )

    joined = placed.join(settled, keys, "left")
    copy = F.col("__pos") - F.when(F.coalesce("lost", F.lit(False)), 0).otherwise(1)
    skipped = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("__copy"))), F.lit(0))
    joined = joined.withColumn("__copy", copy)
    entry = F.when(F.col("__copy") == 0, F.col("path")).otherwise(
        _suffixed(F.col("path"), F.col("__copy") + 1 + F.greatest(skipped, F.lit(0)))
    )
    out = joined.withColumn("entry_path", entry).drop("__pos", "__copy", "lost", "cuts")
    return out.drop("path").withColumnRenamed("__path", path) if path != "path" else out


def archive_manifest(items: DataFrame, chunk_rows: int = 1_000_000) -> DataFrame:
    """Done items with output, ``(run_id, item_id, seq, entry_path, bytes, offset, progress)``.

    ``offset`` is where the payload of an item begins; ``progress`` is the share written after it.
    """
    rows = items.where((F.col("status") == "done") & F.col("out_size").isNotNull())
    total = rows.groupBy("run_id").agg(F.sum("out_size").cast("double").alias("__all"))
    summed = running_sum(
        rows, ["run_id"], [F.col("seq")], F.col("out_size"), "__end", chunk_rows
    ).join(total, "run_id")
    share = F.least(dbl(1), F.col("__end").cast("double") / F.nullif(F.col("__all"), dbl(0)))
    return summed.select(
        "run_id", "item_id", "seq", "entry_path", F.col("out_size").alias("bytes"),
        (F.col("__end") - F.col("out_size")).alias("offset"), share.alias("progress"),
    )


def _set_pending(items: DataFrame, which: Column, drop_output: bool) -> DataFrame:
    changes = {"status": F.when(which, "pending").otherwise(F.col("status"))}
    if "error" in items.columns:
        changes["error"] = F.when(~which, F.col("error"))
    if drop_output:
        changes["out_size"] = F.when(~which, F.col("out_size"))
    return items.withColumns(changes)


def retry_failed(items: DataFrame) -> DataFrame:
    """Error rows back to pending, message cleared."""
    return _set_pending(items, F.col("status") == "error", False)


def cancel_run(items: DataFrame) -> DataFrame:
    """Processing rows back to pending; done rows stay."""
    return _set_pending(items, F.col("status") == "processing", False)


def reset_items(items: DataFrame) -> DataFrame:
    """Every row back to pending, outputs dropped."""
    return _set_pending(items, F.lit(True), True)
