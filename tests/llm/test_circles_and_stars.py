"""Texts that run in circles are few paths (5); components join what an earlier result knows (9)."""

import random
from collections import Counter

from assetlane.llm import components as stars
from assetlane.llm import substring
from assetlane.llm.components import components
from test_text_operators import removed_by_brute_force


def test_a_text_in_circles_is_few_paths(spark):
    """Runs of two words in turn, of several lengths and after other words: every period is the same path."""
    rng = random.Random(5)
    rows = [(i, " ".join([f"a{rng.random()}" for _ in range(i)] + ["left", "right"] * (100 + 20 * i) + [f"z{i}"] * (i % 3)))
            for i in range(12)]
    rows += [(20, rows[4][1]), (21, "left right " * 26 + " ".join(f"own{i}" for i in range(80)) + " left right" * 40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    raw = substring._texts(docs, "doc_id", "text")
    held = [len(r.paths) for r in substring.paths(raw, substring.SIZE, substring.ANCHOR).collect()]
    assert len(held) == len(rows) and max(held) < 30
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(spark, docs).collect())
    assert got == removed_by_brute_force(rows, 50)


def test_components_join_known_ones(spark):
    """Two known stars and a node of neither; links that say nothing new, and new ones."""
    known = spark.createDataFrame([(1, 1), (4, 1), (7, 1), (2, 2), (5, 2), (30, 30), (31, 30)], "node bigint, comp bigint")
    links = spark.createDataFrame([(7, 4), (5, 7), (9, 5), (12, 11), (9, 9)], "x bigint, y bigint")
    got = sorted((r["node"], r["comp"]) for r in components(spark, links, known).collect())
    assert got == [(1, 1), (2, 1), (4, 1), (5, 1), (7, 1), (9, 1), (11, 11), (12, 11), (30, 30), (31, 30)]


def test_stars_are_done_at_once(spark, monkeypatch):
    """A table of stars is written once and not worked on."""
    written, real = [], stars.store
    monkeypatch.setattr(stars, "store", lambda s, df, name: (written.append(name), real(s, df, name))[1])
    links = spark.range(1, 40).selectExpr("id + 100 * (id % 3) AS x", "id % 3 - 5 AS y")
    got = {(r["node"], r["comp"]) for r in components(spark, links).collect()}
    assert got == {(i + 100 * (i % 3), i % 3 - 5) for i in range(1, 40)} | {(i - 5, i - 5) for i in range(3)}
    assert written == ["links", "components"]
