"""What is cut follows from which stream draws which form: no stream is replayed for it, and levels are met once."""
import random

import pytest

from assetlane.operators import drawing

OPS = "doc_id int, {0} int, op_no int, op string, args array<double>, name string"
XOBJECTS = "doc_id int, owner string, name string, kind string, ref int, matrix array<double>"


def plain(pages, forms, depth):
    """Every way from a page down, one draw at a time."""
    out = set()

    def down(page, form, path):
        for inner in forms.get(form, ()) if path else pages[page]:
            if inner in path if depth is None else len(path) >= depth:
                out.add((1, page, form, inner))
            else:
                down(page, inner, (*path, inner))

    for page in pages:
        down(page, None, ())
    return out


@pytest.mark.parametrize("depth", [None, 0, 1, 3, 4, 5, 9])
def test_cut_draws_match_a_plain_loop_without_replay(spark, monkeypatch, depth):
    """Circles and forms drawn on several ways; depths on both sides of a stored level."""
    monkeypatch.setattr(drawing, "stream_draws", lambda *_: pytest.fail("streams are replayed"))
    rng = random.Random(5)
    pages = {p: sorted(rng.sample(range(6), 2)) for p in range(3)}
    forms = {f: sorted(rng.sample(range(6), rng.choice([0, 1, 2]))) for f in range(6)}
    draws = lambda of: [(1, n, i, "Do", None, f"F{f}") for n, inner in of.items() for i, f in enumerate([*inner, *inner])]
    named = [(1, f"{side}{n}", f"F{f}", "form", f, None) for side, of in (("p", pages), ("f", forms)) for n, inner in of.items() for f in inner]
    named += [(1, "p0", "F9", "image", 9, None), (1, "p00", f"F{pages[0][0]}", "form", 5, None), (1, "x", "F1", "form", 1, None)]
    ops = [spark.createDataFrame([*draws(of), (1, 0, 99, "Do", None, None), (1, 0, 98, "q", None, "F1")], OPS.format(side))
           for of, side in ((pages, "page"), (forms, "form"))]
    got = [tuple(r) for r in drawing.cut_draws(*ops, spark.createDataFrame(named, XOBJECTS), max_depth=depth).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(pages, forms, depth)
