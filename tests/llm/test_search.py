"""Ranked search, collocations and the metric join against plain loops, on edge rows too."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from assetlane.llm import collocations as co
from assetlane.llm import lexical, metric_join
from assetlane.llm.collocations import collocations
from assetlane.llm.lexical import lexical_search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, k):
    held = [(i, Counter(TERM.findall(t.translate(LOWER)))) for i, t in docs if i is not None and t is not None]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        if item is None or text is None:
            continue
        scores = []
        for i, c in held:
            m = 25 + 75 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in TERM.findall(text.translate(LOWER)) if t in c)
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


ITEMS = [(1, "w1 w2 W3 w3, w3; w5!"), (2, "Été naïve w9 ß 日本語 nowhere"), (3, None), (4, ""), (5, "...!"), (None, "w1"),
         (1, "w1 w2 W3 w3, w3; w5!"), (6, "tok " * 50 + "w7"), (7, " ".join(f"w{i}" for i in range(60)))]


@pytest.mark.parametrize("group_terms", [1 << 19, 7])
def test_search_matches_a_plain_loop(spark, docs, texts, group_terms):
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in ITEMS], "item_id bigint, text string, doc_id string, score int")
    got = lexical_search(spark, docs, items, group_terms=group_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain_search(texts, ITEMS, 10)


def test_search_edges(spark, docs, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert lexical_search(spark, no_docs, items).count() == 0
    assert lexical_search(spark, docs, none).count() == 0
    tied = spark.createDataFrame([(i, "same words here") for i in range(40, 0, -1)], "doc_id bigint, text string")
    got = lexical_search(spark, tied.repartition(5), spark.createDataFrame([(9, "same words")], "item_id bigint, text string"), k=7)
    assert [(r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [(i, i) for i in range(1, 8)]


def test_tiles_stay_exact(monkeypatch):
    """Weights too heavy for one exact product are split over tiles that add up."""
    monkeypatch.setattr(lexical, "TILE_TERMS", 3)
    repeats = np.array([1, 40_000_000, 2, 7, 1_000_000_000, 5, 1])
    group = lexical.Group([10, 11], np.arange(5, dtype=np.uint64), np.array([0, 0, 0, 1, 1, 1, 1]), np.array([0, 1, 4, 0, 1, 2, 3]), repeats)
    weight = np.array([1000, 900, 0, 41_000, 7])
    dense = np.zeros((5, 2), dtype=object)
    for i, t, n in zip(group.item, group.term, repeats):
        dense[t, i] += int(n) * int(weight[t])
    total = np.zeros((5, 2), dtype=object)
    tiles = lexical.weight_tiles(group, weight)[0]
    for tile in tiles:
        assert len(tile.terms) <= 3 and tile.weights.sum(axis=0).max() * lexical.TOP_IMPACT < 2 ** 53
        for row, t in zip(tile.weights, tile.terms):
            total[t] += row.astype(np.int64).astype(object)
    assert len(tiles) > 100 and (total == dense).all()
    assert lexical.length_norm(np.array([10 ** 12]), 10 ** 12, 10 ** 13).tolist() == [25 + 75 * 10 ** 11]


def plain_collocations(docs, least, top, covered):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\t]+", piece)
            total[lang] += len(words)
            for m in (1, 2, 3):
                counts.update((lang, *words[i:i + m]) for i in range(len(words) - m + 1))
    cand = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    hidden = {(p[0], *part) for p, a in cand.items() if len(p) == 4 for part in (p[1:3], p[2:4])
              if 100 * a >= covered * counts[(p[0], *part)]}
    rows = {}
    for p, a in cand.items():
        if p in hidden:
            continue
        cuts = [(10 ** 6 * a * a // (counts[p[:1 + k]] * counts[(p[0], *p[1 + k:])]), k, counts[p[:1 + k]], counts[(p[0], *p[1 + k:])])
                for k in range(1, len(p) - 1)]
        score, _, l, r = min(cuts)
        rows.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return sorted((lang, i, p.decode(), -a, l, r, total[lang], -s)
                  for lang, found in rows.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


def phrase_rows():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(25)] + ["Été", "ß", "日本"]
    rows = []
    for i in range(300):
        words = [rng.choice(vocab[:4 + i % 25]) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            words[rng.randint(0, len(words)):0] = ["New", "york", "City"] if rng.random() < 0.8 else ["new", "York"]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", "\n", ". ", "\x0b"]) for w in words)
        rows.append((["en", "de", None, "", "und"][i % 5], text))
    return rows + [("en", None), ("xx", ""), ("fr", "one two"), rows[3], rows[3]]


@pytest.mark.parametrize("head", [1 << 18, 12, 0])
def test_collocations_match_a_plain_loop(spark, head):
    """With a large head, with most units beyond it, and with no head at all."""
    rows = phrase_rows()
    docs = spark.createDataFrame([(t, lang, 1, "p") for lang, t in rows], "text string, lang string, n int, phrase string").repartition(3)
    got = collocations(spark, docs, least=4, top=40, head=head)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain_collocations(rows, 4, 40, 50)
    assert len(want) > 100 and sorted(tuple(r) for r in got.collect()) == want


def test_collocations_of_nothing(spark, no_docs):
    assert collocations(spark, no_docs).count() == 0
    few = spark.createDataFrame([("en", "a b a b"), (None, None)], "lang string, text string")
    assert collocations(spark, few).count() == 0
    assert [tuple(r) for r in collocations(spark, few, least=2).collect()] == [("en", 1, "a b", 2, 2, 2, 4, 1_000_000)]


def test_pair_tiles_agree(monkeypatch):
    """Dense tiles, sparse tiles and pairs beyond the head give one count for each pair."""
    rng = np.random.default_rng(1)
    codes = rng.choice(1 << 62, 60, replace=False).astype(np.uint64)
    x, y = codes[rng.integers(0, 60, 5000) % rng.integers(1, 60, 5000)], codes[rng.integers(0, 60, 5000)]
    want = Counter(zip(x.tolist(), y.tolist()))
    monkeypatch.setattr(co, "TILE", 8)
    for dense, head in ((1, 60), (10 ** 9, 60), (90, 60), (90, 20), (90, 0)):
        monkeypatch.setattr(co, "DENSE", dense)
        order = np.argsort(codes[:head])
        units = co.Units(codes[:head][order], order, codes[:head], np.zeros(1, np.uint64))
        got = Counter()
        for a, b, n in co.count_pairs(x, y, units):
            got.update(dict(zip(zip(units.codes(a).tolist(), units.codes(b).tolist()), n.tolist())))
        assert got == want


def plain_links(rows, least):
    def fine(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and fine(a) and fine(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                p, q = (np.array(v) / max(abs(x) for x in v) for v in (a[1], b[1]))
                if p @ q / math.sqrt((p @ p) * (q @ q)) >= least:
                    n[i] += 1
                    root[find(i)] = find(j)
    out = []
    for i, r in enumerate(rows):
        comp = None if r[0] is None else min(rows[j][0] for j in range(len(rows)) if rows[j][0] is not None and find(j) == find(i))
        out.append((r[0], n[i], comp, r[0] is None or r[0] == comp))
    return sorted(out, key=str)


def vector_rows():
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 6))
    rows = []
    for i in range(260):
        spread = [0.0, 0.02, 0.06, 0.12, 0.4][i % 5]
        v = centres[i % 12 if i % 3 else 0] + rng.normal(size=6) * spread
        rows.append((1000 - i, [float(x) for x in v * [1, 3, 0.1][i % 3]], i % 2 if i % 7 else 0))
    rows += [(1, None, 0), (2, [0.0] * 6, 0), (3, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (4, [math.nan] * 6, 0), (5, [math.inf] + [0.0] * 5, 0),
             (6, rows[0][1], None), (None, rows[0][1], 0), (7, [1.0, 0.0], 0), (8, [2.0, 0.0], 0), (9, [], 0), (10, [1e300] * 6, 0), (11, [1e-300] * 6, 0)]
    return rows + [rows[0], rows[0], (rows[1][0], rows[4][1], rows[4][2])]


@pytest.mark.parametrize("pivots, block", [(None, 2048), (1, 16), (9, 10), (40, 64)])
def test_metric_join_matches_all_pairs(spark, pivots, block):
    rows = vector_rows()
    vectors = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<double>, label int, cls string, n int").repartition(4)
    got = metric_join.metric_join(spark, vectors, block=block, pivots=pivots)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_links(rows, 0.98)


def test_metric_join_of_floats_and_of_nothing(spark):
    rows = vector_rows()
    vectors = spark.createDataFrame([r for r in rows if r[0] not in (10, 11)], "vec_id bigint, embedding array<float>, label int")
    held = [tuple(r) for r in vectors.collect()]
    assert sorted((tuple(r) for r in metric_join.metric_join(spark, vectors, least=0.9).collect()), key=str) == plain_links(held, 0.9)
    assert metric_join.metric_join(spark, vectors.where("false")).count() == 0


def test_pivots_are_worth_their_copies():
    """Scattered vectors are not copied over many cells; clustered ones are cut finely."""
    rng = np.random.default_rng(2)
    scattered = metric_join.unit(rng.normal(size=(1000, 64)))
    clustered = metric_join.unit(np.repeat(rng.normal(size=(100, 64)), 10, axis=0) + rng.normal(size=(1000, 64)) * 0.001)
    few = metric_join.choose_pivots(scattered, 10_000, 0.2)
    many = metric_join.choose_pivots(clustered, 10_000_000, 0.02)
    assert len(few) < len(many)
