"""Queries on encoder sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F

from assetlane.functions import report, savings
from assetlane.functions.encoders import ENCODERS
from assetlane.operators import sweep
from assetlane.suite.fixtures import read, view, with_views
from assetlane.suite.registry import case

_CELLS = with_views("v_cells")
_PCT = "CAST(floor(CAST(original_bytes - size AS DOUBLE) / original_bytes * 100 + 0.5) AS BIGINT)"


@case(
    "savings",
    f"""{_CELLS}, c AS (SELECT image_id, row, col, original_bytes, CASE WHEN status = 'done' THEN size END AS size FROM v_cells)
 SELECT image_id, row, col, CASE WHEN size IS NOT NULL THEN {_PCT} END AS saved_pct, 1 - CAST(size AS DOUBLE) / original_bytes AS saved_frac,
 CAST(size AS DOUBLE) / original_bytes AS ratio, original_bytes - size AS delta FROM c""",
)
def _(spark, sf_dir):
    cells = view(spark, sf_dir, "v_cells").withColumn("size", F.when(F.col("status") == "done", F.col("size")))
    return savings.savings(cells).select(
        "image_id", "row", "col", "saved_pct", "saved_frac", "ratio", "delta"
    )


def _sql_ladder(table, field, unmeasured):
    rungs = " ".join(
        f"WHEN ssim >= {cut} THEN '{row[field - 1]}'" for cut, *row in table if cut is not None
    )
    return f"CASE WHEN ssim IS NULL THEN '{unmeasured}' {rungs} ELSE '{table[-1][field]}' END"


_VERDICT = _sql_ladder(savings.VERDICTS, 1, "Unmeasured")


@case(
    "verdicts",
    f"""{_CELLS} SELECT image_id, row, col, {_VERDICT} AS verdict, {_sql_ladder(savings.VERDICTS, 2, 'ok')} AS tone,
 {_sql_ladder(savings.CAPTIONS, 1, 'Not measured')} AS caption, {_sql_ladder(savings.CAPTIONS, 2, 'Unmeasured')} AS short,
 CASE WHEN ssim IS NULL THEN 'muted' WHEN ssim >= 0.985 THEN 'green' WHEN ssim >= 0.96 THEN 'yellow' ELSE 'red' END AS accent FROM v_cells""",
)
def _(spark, sf_dir):
    return savings.verdicts(view(spark, sf_dir, "v_cells")).select(
        "image_id", "row", "col", "verdict", "tone", "caption", "short", "accent"
    )


def sql_fixed(x, digits):
    """Exact halves (multiples of 1/16 here) go up; printf would take the even digit."""
    return f"printf('%.{digits}f', ({x}) + CASE WHEN ({x}) * 16 = floor(({x}) * 16) THEN CAST(0.000000001 AS DOUBLE) ELSE 0 END)"


def _sql_bytes(x):
    """SI size text of a bigint expression below 1 GB."""
    def unit(div, name):
        v = f"({x})" + " / CAST(1000 AS DOUBLE)" * div
        return (f"concat(CASE WHEN {v} < 10 THEN {sql_fixed(v, 2)} WHEN {v} < 100 THEN {sql_fixed(v, 1)} "
                f"ELSE {sql_fixed(v, 0)} END, ' {name}')")

    return (f"CASE WHEN ({x}) IS NULL OR ({x}) <= 0 THEN '0 B' WHEN ({x}) < 1000 THEN concat(CAST(({x}) AS VARCHAR), ' B') "
            f"WHEN ({x}) < 1000000 THEN {unit(1, 'kB')} ELSE {unit(2, 'MB')} END")


def _sql_signed(p, minus):
    return (f"CASE WHEN ({p}) IS NULL OR ({p}) = 0 THEN '0%' WHEN ({p}) > 0 THEN concat('{minus}', CAST(({p}) AS VARCHAR), '%') "
            f"ELSE concat('+', CAST(abs({p}) AS VARCHAR), '%') END")


@case(
    "report_text",
    f"""{_CELLS} SELECT image_id, row, col, {_sql_bytes('size')} AS size_text, {_sql_signed(_PCT, '-')} AS saved_text,
 {_sql_signed(_PCT, report.MINUS)} AS savings_text,
 CASE WHEN original_bytes = size THEN 'same size' WHEN original_bytes > size THEN concat({_sql_bytes('original_bytes - size')}, ' saved')
  ELSE concat({_sql_bytes('size - original_bytes')}, ' larger') END AS delta_text,
 CASE WHEN ssim IS NULL THEN '{report.DASH}' ELSE {sql_fixed('ssim', 3)} END AS ssim_text,
 concat(CASE WHEN lossless THEN 'e' ELSE 'q' END, CAST(step AS VARCHAR)) AS step_text FROM v_cells""",
)
def _(spark, sf_dir):
    return report.report_text(view(spark, sf_dir, "v_cells")).select(
        "image_id", "row", "col", "size_text", "saved_text", "savings_text", "delta_text", "ssim_text", "step_text"
    )


_WORDS = ", ".join(f"'{w}'" for w in report.NUMBER_WORDS)


@case(
    "sweep_headline",
    f"""{_CELLS}, l AS (SELECT image_id, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, list(DISTINCT encoder ORDER BY encoder) AS encoders FROM v_cells WHERE status = 'done' GROUP BY image_id)
 SELECT image_id, CASE WHEN n <= 20 THEN list_extract([{_WORDS}], n + 1) ELSE CAST(n AS VARCHAR) END AS word,
 CASE WHEN len(encoders) = 1 THEN encoders[1] ELSE concat(array_to_string(encoders[:-2], ', '), ' and ', encoders[-1]) END AS encoder_list,
 concat({_sql_bytes('bytes')}, ' {report.DOT} ', CAST(n AS VARCHAR), ' {report.TIMES} ', '4') AS source_text, {sql_fixed('bytes / CAST(1000 AS DOUBLE)', 1)} AS seconds_text FROM l""",
)
def _(spark, sf_dir):
    """Headline strings per image: number words, lists, sources and seconds."""
    done = view(spark, sf_dir, "v_cells").where(F.col("status") == "done").groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"),
        F.array_sort(F.collect_set("encoder")).alias("encoders"),
    )
    return done.select(
        "image_id", report.number_word(F.col("n")).alias("word"),
        report.join_list(F.col("encoders")).alias("encoder_list"),
        report.format_source(F.col("bytes"), F.col("n"), F.lit(4)).alias("source_text"),
        report.format_seconds(F.col("bytes")).alias("seconds_text"),
    )


def _plan_sql():
    rows = []
    for r, enc in enumerate(sweep.SWEEP_ENCODERS):
        for c, step in enumerate(sweep.steps_for(enc, sweep.QUALITY_STEPS, sweep.EFFORT_STEPS)):
            slow = enc in ("oxipng", "qoi")
            rows.append(f"({r}, {c}, '{enc}', {step}, '{'Effort' if slow else 'Quality'} {step}', {slow}, '{sweep.step_settings(enc, step)}')")
    return f"grid(row, col, encoder, step, step_label, lossless, settings_json) AS (VALUES {', '.join(rows)})"


@case(
    "sweep_plan",
    f"{with_views('v_images')}, {_plan_sql()} SELECT i.image_id, i.original_bytes, grid.* FROM v_images i CROSS JOIN grid",
)
def _(spark, sf_dir):
    return sweep.sweep_plan(view(spark, sf_dir, "v_images").select("image_id", "original_bytes"))


@case(
    "score_sweep",
    f"""{with_views('v_images', 'v_cells')}, {_plan_sql()}, p AS (SELECT i.image_id, i.original_bytes, grid.* FROM v_images i CROSS JOIN grid),
 r AS (SELECT image_id, row, col, status AS st, size AS sz, ssim AS ss FROM v_cells WHERE status <> 'pending'),
 j AS (SELECT p.image_id, p.row, p.col, p.encoder, p.step, p.original_bytes, coalesce(st, 'pending') AS status,
  CASE WHEN st = 'done' THEN sz END AS size, CASE WHEN st = 'done' THEN ss END AS ssim FROM p LEFT JOIN r ON p.image_id = r.image_id AND p.row = r.row AND p.col = r.col)
 SELECT image_id, row, col, encoder, step, status, size, CASE WHEN status = 'done' THEN {_PCT} ELSE 0 END AS saved_pct, ssim,
  CASE WHEN status = 'error' THEN 'Failed' WHEN status = 'pending' THEN 'Unmeasured' ELSE {_VERDICT} END AS verdict,
  CASE WHEN status = 'error' THEN 'codec failed' END AS error FROM j""",
)
def _(spark, sf_dir):
    results = view(spark, sf_dir, "v_cells").where(F.col("status") != "pending").select(
        "image_id", "row", "col", "status", "size", "ssim",
        F.when(F.col("status") == "error", "codec failed").alias("error"), F.lit(1.5).alias("ms"),
    )
    images = view(spark, sf_dir, "v_images")
    cells = sweep.score_sweep(sweep.sweep_plan(images.select("image_id")), results, images)
    return cells.select(
        "image_id", "row", "col", "encoder", "step", "status", "size", "saved_pct", "ssim", "verdict", "error"
    )


# Ranked step by step as the rule reads, which is not how the operator computes it.
_PICKS = f"""{_CELLS}, c AS (SELECT *, {_PCT} AS saved FROM v_cells WHERE status = 'done'),
 m AS (SELECT *, bool_or(ssim IS NOT NULL) OVER w AS measured, bool_or(ssim >= 0.985) OVER w AS any_good,
  bool_or(lossless OR step >= 50) OVER w AS any_trusted,
  row_number() OVER (PARTITION BY image_id ORDER BY ssim DESC NULLS LAST, row, col) AS by_ssim FROM c WINDOW w AS (PARTITION BY image_id)),
 p AS (SELECT * FROM m WHERE CASE WHEN measured AND any_good THEN ssim >= 0.985 WHEN measured THEN by_ssim = 1 WHEN any_trusted THEN lossless OR step >= 50 ELSE true END),
 q AS (SELECT *, bool_or(saved >= 5) OVER (PARTITION BY image_id) AS any_worth FROM p),
 picks AS (SELECT image_id, row, col, encoder, step, size, ssim FROM q WHERE saved >= 5 OR NOT any_worth
  QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY size, coalesce(ssim, 0) DESC, row, col) = 1)"""


@case("recommend", f"{_PICKS} SELECT * FROM picks")
def _(spark, sf_dir):
    return sweep.recommend(view(spark, sf_dir, "v_cells"))


@case(
    "lowest_quality",
    f"""{_CELLS} SELECT image_id, encoder, step, size FROM v_cells WHERE status = 'done' AND NOT lossless AND ssim >= 0.99 AND step BETWEEN 30 AND 95
 QUALIFY row_number() OVER (PARTITION BY image_id, encoder ORDER BY step) = 1""",
)
def _(spark, sf_dir):
    return sweep.lowest_quality(view(spark, sf_dir, "v_cells"))


def _coefficients(spark, sf_dir):
    whole = "transform(embedding, x -> CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT))"
    return read(spark, sf_dir, "embeddings").selectExpr("vec_id AS image_id", f"{whole} AS k")


@case(
    "search_quality",
    """WITH RECURSIVE e AS (SELECT vec_id AS image_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS k FROM embeddings),
 q AS (SELECT CAST(unnest(range(30, 96)) AS INTEGER) AS step),
 c AS (SELECT image_id, unnest(k) AS k FROM e),
 t AS (SELECT image_id, step, count(*) FILTER (abs(k) >= 96 - step) * 3 AS size, CAST(coalesce(sum(k * k) FILTER (abs(k) >= 96 - step), 0) AS DOUBLE) / nullif(CAST(sum(k * k) AS DOUBLE), 0) AS ssim
   FROM c, q GROUP BY ALL),
 s(image_id, low, high, step, encodes) AS (SELECT image_id, 30, 95, CAST(NULL AS INTEGER), 0 FROM e
   UNION ALL SELECT s.image_id, CASE WHEN ok THEN low ELSE mid + 1 END, CASE WHEN ok THEN mid - 1 ELSE high END, CASE WHEN ok THEN mid ELSE s.step END, encodes + 1
   FROM (SELECT s.*, CAST((low + high) // 2 AS INTEGER) AS mid, coalesce(t.ssim >= 0.95, false) AS ok FROM s LEFT JOIN t ON t.image_id = s.image_id AND t.step = (low + high) // 2 WHERE low <= high AND encodes < 6) AS s),
 f AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY encodes DESC) AS back FROM s)
 SELECT f.image_id, CAST(f.step AS INTEGER) AS step, t.size, t.ssim, CAST(encodes AS INTEGER) AS encodes, low > high AS exact FROM f LEFT JOIN t ON t.image_id = f.image_id AND t.step = f.step WHERE back = 1""",
)
def _(spark, sf_dir):
    """Vectors coded by leaving out small coefficients, as many as the step allows; kept energy is the measure."""
    coded = _coefficients(spark, sf_dir)

    def probe(wanted):
        stays = F.filter("k", lambda k: F.abs(k) >= 96 - F.col("step"))

        def energy(k):
            return F.aggregate(k, F.lit(0).cast("bigint"), lambda n, v: n + v * v).cast("double")

        total = energy(F.col("k"))
        return wanted.join(coded, "image_id").select(
            "image_id", "step", (F.size(stays) * 3).alias("size"), F.when(total > 0, energy(stays) / total).alias("ssim"))

    return sweep.search_quality(coded, probe, target=0.95)


@case(
    "bar_percent",
    f"""{_CELLS}, c AS (SELECT image_id, row, col, CASE WHEN status = 'done' THEN size END AS size FROM v_cells),
 m AS (SELECT *, coalesce(max(size) OVER (PARTITION BY image_id, row), 0) AS row_max FROM c)
 SELECT *, CASE WHEN size IS NULL OR row_max <= 0 THEN 0 ELSE greatest(2, least(100, CAST(floor(CAST(size AS DOUBLE) / row_max * 100 + 0.5) AS BIGINT))) END AS bar_pct FROM m""",
)
def _(spark, sf_dir):
    cells = view(spark, sf_dir, "v_cells").withColumn("size", F.when(F.col("status") == "done", F.col("size")))
    return sweep.bar_percent(cells).select("image_id", "row", "col", "size", "row_max", "bar_pct")


@case(
    "sweep_summary",
    f"""{_PICKS}, n AS (SELECT image_id, count(*) AS total, count(*) FILTER (status = 'done') AS completed, count(*) FILTER (status = 'error') AS failed,
  bool_or(status = 'done' AND ssim IS NOT NULL) AS measured FROM v_cells GROUP BY image_id)
 SELECT n.*, encoder AS recommended, step AS recommended_step, size AS recommended_size FROM n LEFT JOIN picks USING (image_id)""",
)
def _(spark, sf_dir):
    return sweep.sweep_summary(view(spark, sf_dir, "v_cells"))


@case(
    "excluded_encoders",
    f"""{_CELLS}, dim(encoder, ord, label) AS (VALUES {', '.join(f"('{e[0]}', {i}, '{e[1]}')" for i, e in enumerate(ENCODERS))})
 SELECT encoder, label, ord FROM dim WHERE encoder <> 'identity' AND encoder NOT IN (SELECT DISTINCT encoder FROM v_cells)""",
)
def _(spark, sf_dir):
    return sweep.excluded_encoders(spark, view(spark, sf_dir, "v_cells"))


@case(
    "sweep_matrix",
    _CELLS + " SELECT image_id, row, encoder, " + ", ".join(
        f"max(size) FILTER (col = {c}) AS size_{c}, max(ssim) FILTER (col = {c}) AS ssim_{c}" for c in range(4)
    ) + " FROM v_cells GROUP BY image_id, row, encoder",
)
def _(spark, sf_dir):
    return sweep.sweep_matrix(view(spark, sf_dir, "v_cells"))
