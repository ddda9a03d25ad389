import math
import random

import pytest
from pyspark.sql import functions as F

from assetlane.operators import drawing, pdf

OPS = "doc_id int, page int, op_no int, op string, args array<double>, name string"
FORM_OPS = OPS.replace("page", "form")
XOBJECTS = "doc_id int, owner string, name string, kind string, ref int, matrix array<double>"
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m, n):
    a, b, c, d, e, f = m
    g, h, i, j, k, p = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + p)


def replay(ops, base=IDENTITY):
    """Plain stack machine, for comparison."""
    ctm, stack, out = base, [], []
    for op, args, name in ops:
        if op == "q":
            stack.append(ctm)
        elif op == "Q" and stack:
            ctm = stack.pop()
        elif op == "cm" and args and len(args) >= 6 and all(v is not None and math.isfinite(v) for v in args[-6:]):
            ctm = times(tuple(args[-6:]), ctm)
        elif op == "Do":
            out.append((name, ctm))
    return out


def table(spark, streams, schema=OPS):
    rows = [(d, p, i, op, args, name) for (d, p), ops in streams.items() for i, (op, args, name) in enumerate(ops)]
    return spark.createDataFrame(rows, schema)


def random_stream(rng, n):
    ops = []
    for _ in range(n):
        kind = rng.choice(["q", "Q", "Q", "q", "cm", "cm", "Do"])
        args = [float(rng.randint(-2, 2)) for _ in range(rng.choice([6, 6, 7, 5]))] if kind == "cm" else None
        ops.append((kind, args, "Im" if kind == "Do" else None))
    return ops


@pytest.mark.parametrize("chunk", [3, 7, 4096])
def test_chunked_replay_equals_one_pass(spark, chunk):
    rng = random.Random(chunk)
    streams = {(1, p): random_stream(rng, rng.randint(1, 60)) for p in range(25)}
    ops = table(spark, streams).withColumn("owner", F.col("page").cast("string"))
    got = {}
    for r in drawing.stream_draws(ops, chunk).orderBy("owner", "op_no").collect():
        got.setdefault(int(r.owner), []).append((r.name, tuple(r.m)))
    assert got == {p: replay(ops) for (_, p), ops in streams.items() if replay(ops)}


def test_forms_nest_and_stop_at_depth(spark):
    move = lambda x: [1.0, 0.0, 0.0, 1.0, float(x), 0.0]
    pages = table(spark, {(1, 0): [("cm", move(1), None), ("Do", None, "F1"), ("Do", None, "Pic"), ("Do", None, "None")]})
    chain = {(1, k): [("cm", move(10**k), None), ("Do", None, "Pic"), ("Do", None, f"F{k + 1}")] for k in range(1, 5)}
    forms = table(spark, chain, FORM_OPS)
    objects = [(1, "p0", "F1", "form", 1, move(5)), (1, "p0", "Pic", "image", 50, None)]
    for k in range(1, 5):
        objects += [(1, f"f{k}", "Pic", "image", 50 + k, None), (1, f"f{k}", f"F{k + 1}", "form", k + 1, None)]
    found = drawing.ctm_walk(pages, forms, spark.createDataFrame(objects, XOBJECTS), max_depth=3)
    assert sorted((r.ref, r.e) for r in found.collect()) == [(50, 1.0), (51, 16.0), (52, 116.0), (53, 1116.0)]


@pytest.mark.parametrize("fan", [2, 3, 64])
def test_starting_states_over_many_levels(spark, fan):
    """Chunks of 2 operators, merged 2, 3 or all at once; restores outnumber saves in places."""
    rng = random.Random(fan)
    streams = {(1, p): random_stream(rng, rng.randint(20, 150)) for p in range(8)}
    rows = []
    for (d, p), stream in streams.items():
        kept = [(op, tuple(args[-6:]) if args and len(args) >= 6 else None, name) for op, args, name in stream]
        kept = [o for o in kept if o[0] in "qQ" or o[1]]
        rows += [(d, str(p), i // 2, i, op, list(m) if m else None, name) for i, (op, m, name) in enumerate(kept)]
    ops = spark.createDataFrame(rows, "doc_id int, owner string, chunk bigint, op_no bigint, op string, m array<double>, name string")
    chunks = ops.groupBy("doc_id", "owner", "chunk").agg(F.array_sort(F.collect_list(F.struct("op_no", "op", "m", "name"))).alias("ops"))
    got = {(r.owner, r.chunk): (tuple(r.ctm), [tuple(m) for m in r.stack]) for r in drawing.starting_states(chunks, fan).collect()}
    for owner in {r[1] for r in rows}:
        ctm, stack = IDENTITY, []
        for _, _, chunk, i, op, m, _ in sorted(r for r in rows if r[1] == owner):
            if i % 2 == 0:
                assert got[owner, chunk] == (ctm, stack)
            if op == "q":
                stack = [*stack, ctm]
            elif op == "Q" and stack:
                ctm, stack = stack[-1], stack[:-1]
            elif op == "cm":
                ctm = times(tuple(m), ctm)


def test_what_is_cut_is_listed(spark):
    """A cycle of two forms, a form beside it, and a form that no page draws."""
    do = lambda *names: [("Do", None, n) for n in names]
    pages = table(spark, {(1, 0): do("A", "C", "Pic"), (2, 5): do("A")})
    forms = table(spark, {(1, 1): do("Pic", "B"), (1, 2): do("Pic", "A"), (1, 3): do("Pic"), (1, 4): do("A")}, FORM_OPS)
    objects = [(d, o, n, "form", ref, None) for d, o, n, ref in
               [(1, "p0", "A", 1), (1, "p0", "C", 3), (1, "f1", "B", 2), (1, "f2", "A", 1), (1, "f4", "A", 1)]]
    objects += [(1, o, "Pic", "image", 7, None) for o in ("p0", "f1", "f2", "f3")]
    objects = spark.createDataFrame(objects, XOBJECTS)
    assert drawing.ctm_walk(pages, forms, objects, max_depth=None).count() == 4
    assert drawing.ctm_walk(pages, forms, objects, max_depth=3).count() == 5
    assert [tuple(r) for r in drawing.cut_draws(pages, forms, objects, max_depth=None).collect()] == [(1, 0, 2, 1)]
    assert [tuple(r) for r in drawing.cut_draws(pages, forms, objects, max_depth=3).collect()] == [(1, 0, 1, 2)]
    assert sorted(map(repr, (tuple(r) for r in drawing.cut_draws(pages, forms, objects, max_depth=0).collect()))) == ["(1, 0, None, 1)", "(1, 0, None, 3)"]
    none = pages.where("false")
    assert drawing.cut_draws(none, forms, objects, max_depth=None).count() == 0


def test_a_form_that_draws_itself_ends(spark):
    pages = table(spark, {(1, 0): [("Do", None, "F")]})
    forms = table(spark, {(1, 1): [("Do", None, "F"), ("Do", None, "Pic")]}, FORM_OPS)
    objects = spark.createDataFrame(
        [(1, "p0", "F", "form", 1, None), (1, "f1", "F", "form", 1, None), (1, "f1", "Pic", "image", 2, None)], XOBJECTS)
    assert drawing.ctm_walk(pages, forms, objects, max_depth=4).count() == 4


def placed(spark, *draws):
    return spark.createDataFrame(
        [(1, p, r, float(a), float(b), float(c), float(d), 0.0, 0.0, u) for p, r, a, b, c, d, u in draws],
        "doc_id int, page int, ref int, a double, b double, c double, d double, e double, f double, user_unit double")


def test_dpi_of_the_known_placements(spark):
    images = spark.createDataFrame([(1, r, 120, 90) for r in (1, 2, 3, 4, 5)], "doc_id int, ref int, width int, height int")
    draws = placed(
        spark, (3, 1, 150, 0, 0, 120, 1.0), (0, 1, 0, 150, 120, 0, None), (0, 2, 60, 0, 0, 45, 1.0),
        (1, 3, 150, 0, 0, 120, 2.0), (2, 4, 0, 0, 0, 120, 1.0))
    got = {r.ref: (list(r.pages), r.dpi) for r in pdf.effective_dpi(draws, images).collect()}
    assert got == {1: ([0, 3], pytest.approx(57.6)), 2: ([0], pytest.approx(144)), 3: ([1], pytest.approx(28.8)),
                   4: ([2], None), 5: ([], None)}


BASE = dict(doc_id=1, ref=1, width=100, height=100, filter="FlateDecode", color_space="/DeviceRGB", bpc=8,
            is_mask=False, custom_decode=False, src_bytes=10_000, dpi=None)
IMAGE = ("doc_id int, ref int, width int, height int, filter string, color_space string, bpc int, is_mask boolean, "
         "custom_decode boolean, src_bytes int, dpi double")


def plan(spark, settings=pdf.DEFAULTS, **change):
    row = {**BASE, **change}
    df = spark.createDataFrame([tuple(row[c.split()[0]] for c in IMAGE.split(", "))], IMAGE)
    r = pdf.resample_target(pdf.skip_reason(df, settings), settings).first()
    return r.skip, (r.out_w, r.out_h) if r.out_w is not None else None


def test_skip_rules_in_order(spark):
    assert plan(spark)[0] is None
    assert plan(spark, is_mask=True, color_space="/DeviceCMYK")[0] == "mask"
    assert plan(spark, color_space="/DeviceCMYK", filter="JPXDecode")[0] == "cmyk"
    assert plan(spark, pdf.PdfSettings(flate_to_jpeg=False))[0] == "no-decoder"
    assert plan(spark, filter="DCTDecode", color_space="/ICCBased", src_bytes=1)[0] == "colorspace"
    assert plan(spark, src_bytes=4095)[0] == "too-small" and plan(spark, src_bytes=4096)[0] is None


def test_resample_targets(spark):
    assert plan(spark, width=3000, height=2000, dpi=300.0)[1] == (1500, 1000)
    assert plan(spark, width=9000, height=9000, dpi=100.0)[1] is None
    assert plan(spark, width=4800, height=2400)[1] == (2400, 1200)
    assert plan(spark, width=1, height=9000, dpi=1500.0)[1] == (1, 900)
    assert plan(spark, width=2, height=2, dpi=150.0001)[1] is None


def objects(spark, *rows):
    return spark.createDataFrame(
        rows, "doc_id int, obj_no int, subtype string, width int, smask_ref int, contents binary, is_metadata boolean, is_thumb boolean")


def test_merging_needs_equal_shape_mask_and_bytes(spark):
    df = objects(
        spark, (1, 5, "/Image", 1, None, b"x", False, False), (1, 2, "/Image", 1, None, b"x", False, False),
        (1, 3, "/Image", 1, 9, b"x", False, False), (1, 4, "/Image", 2, None, b"x", False, False),
        (1, 6, "/Image", 1, None, b"y", False, False), (2, 1, "/Image", 1, None, b"x", False, False),
        (1, 7, "/Form", 1, None, b"x", False, False), (1, 8, "/Image", 1, None, b"x", False, False))
    got = sorted(tuple(r) for r in pdf.dedupe_images(df).collect())
    assert got == [(1, 5, 2), (1, 8, 2)]


def test_pruning_keeps_metadata_unless_asked(spark):
    df = objects(spark, (1, 1, "/Image", 1, 2, b"", False, False), (1, 2, "/Image", 1, None, b"", False, False),
                 (1, 3, "", 1, None, b"", True, False), (1, 4, "", 1, None, b"", False, True))
    none = spark.createDataFrame([], "doc_id int, dup_ref int, canonical_ref int")
    replaced = spark.createDataFrame([(1, 1)], "doc_id int, ref int")
    left = lambda strip: sorted(r.obj_no for r in pdf.prune_objects(df, none, replaced, strip).collect())
    assert left(True) == [1] and left(False) == [1, 3, 4]


def test_page_ranges_match_a_plain_loop(spark):
    rng = random.Random(2)
    sets = {(1, 1): set(range(20)), (1, 2): {0, 2, 4, 6}, (1, 3): {3, 4, 7, 8, 9}, (None, 1): {-3, -2, -1, 0, 1}, (2, 1): {rng.randrange(60) for _ in range(40)}}
    rows = [(d, r, p, "x") for (d, r), pages in sets.items() for p in pages for _ in range(1 + p % 2)] + [(1, 1, None, "x"), (1, None, 3, "x")]
    df = spark.createDataFrame(rows, "doc_id int, ref int, page int, block string").repartition(3)
    want = set()
    for key, pages in sets.items():
        for p in sorted(pages):
            if p - 1 not in pages:
                last = p
                while last + 1 in pages:
                    last += 1
                want.add((*key, p, last))
    for block in (1, 2, 4, 7, 4096):
        got = [tuple(r) for r in pdf.page_ranges(df, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert pdf.page_ranges(df.limit(0)).collect() == []


def test_a_logo_on_a_million_pages_is_one_range(spark):
    df = spark.range(1_000_000).selectExpr("1 AS doc_id", "7 AS ref", "id AS page")
    assert [tuple(r) for r in pdf.page_ranges(df).collect()] == [(1, 7, 0, 999_999)]
