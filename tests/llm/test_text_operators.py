"""Word operators against brute force: rules (2), substrings (5), Jaccard (9)."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from assetlane.llm.components import components
from assetlane.llm.jaccard import near_duplicates
from assetlane.llm.quality_rules import fit_accuracies, log_odds, quality_rules
from assetlane.llm import substring
from assetlane.llm.substring import substring_dedup
from assetlane.llm.words import chunks, normal_text, split

WORD = re.compile("[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n\t\x0b 日", max_size=40), max_size=6))
def test_split_finds_the_words(texts):
    w = split([t.encode() for t in texts])
    for d, t in enumerate(texts):
        a, b = w.first[d], w.first[d + 1]
        assert [w.buf[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b])] == words(t)
        assert normal_text(w, a, b).decode() == " ".join(words(t))
    named = defaultdict(set)
    for d, t in enumerate(texts):
        for word, code in zip(words(t), w.code[w.first[d]:w.first[d + 1]]):
            named[word].add(int(code))
    assert all(len(v) == 1 for v in named.values()) and len({*map(min, named.values())} if named else set()) == len(named)


def test_chunks_cover_every_text():
    texts = [b"x" * n for n in (5, 1, 900, 0, 3, 3, 3)]
    parts = list(chunks(texts, 10))
    assert [i for lo, hi in parts for i in range(lo, hi)] == list(range(len(texts)))
    assert list(chunks([], 10)) == []


def base_counts(text):
    w = words(text)
    tri, covered = Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i:i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), dup, len(covered)


def test_rule_counts_and_verdicts(spark, docs, texts):
    rows = quality_rules(spark, docs).collect()
    assert len(rows) == len(texts)
    want = Counter((i, *base_counts(t)) for i, t in texts)
    assert Counter((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))) for r in rows) == want
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


def test_rules_on_no_rows(spark, no_docs):
    assert quality_rules(spark, no_docs).collect() == []


def test_duplicate_lines_and_repeats_are_counted_within_a_text(spark):
    text = "a b c\nx\na b c\n\n \na b c"
    df = spark.createDataFrame([(1, text), (2, text)], "doc_id bigint, text string")
    assert {(r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules(spark, df).collect()} == {base_counts(text)[3:]}


def test_label_model_recovers_planted_accuracies():
    rng = np.random.default_rng(5)
    good = rng.random(20000) < 0.8
    g, b = np.array([0.995, 0.99, 0.98, 0.985]), np.array([0.5, 0.4, 0.6, 0.3])
    right = rng.random((20000, 4)) < np.where(good[:, None], g, b)
    votes = np.where(right, 1, -1) * np.where(good, 1, -1)[:, None] * (rng.random((20000, 4)) < 0.9)
    patterns, weight = np.unique(votes, axis=0, return_counts=True)
    share, g2, b2 = fit_accuracies(patterns.astype(float), weight.astype(float))
    assert abs(share - 0.8) < 0.05 and np.abs(g2 - g).max() < 0.02 and np.abs(b2 - b).max() < 0.1
    odds = log_odds(share, g2, b2, (patterns > 0).astype(float), (patterns < 0).astype(float))
    assert odds[(patterns >= 0).all(axis=1)].min() > 0


def removed_by_brute_force(texts, size):
    first = {}
    for i, t in texts:
        w = words(t)
        for p in range(len(w) - size + 1):
            if i is not None:
                key = tuple(w[p:p + size])
                first[key] = min(first.get(key, i), i)
    out = Counter()
    for i, t in texts:
        w = words(t)
        gone = set()
        for p in range(len(w) - size + 1):
            if i is not None and first[tuple(w[p:p + size])] < i:
                gone.update(range(p, p + size))
        kept = [x for p, x in enumerate(w) if p not in gone]
        out[(i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    return out


def test_substrings_match_brute_force(spark, docs, texts):
    for size, anchor in ((50, 12), (20, 6)):
        out = substring_dedup(spark, docs, size=size, anchor=anchor).collect()
        want = removed_by_brute_force(texts, size)
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out) == want
        given_texts = Counter((i, t) for i, t in texts)
        for r in out:
            if not r["n_removed"]:
                assert given_texts[(r["doc_id"], r["text"])]
            else:
                assert hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == r["kept_sha256"]
    assert any(n for (_, _, n, _) in want)


def test_substrings_on_no_rows_and_short_texts(spark, no_docs):
    assert substring_dedup(spark, no_docs).collect() == []
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "doc_id bigint, text string")
    assert {r["n_removed"] for r in substring_dedup(spark, df).collect()} == {0}


def test_a_passage_within_one_document_stays(spark):
    body = " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"{body} {body}"), (2, f"x {body}")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup(spark, df).collect()} == {1: 0, 2: 60}


def shingles(text, n=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset({tuple(w)} if w else ())


def components_by_brute_force(texts, percent):
    sets = [shingles(t) for _, t in texts]
    group = list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if texts[a][0] is not None and texts[b][0] is not None and sets[a]:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    group[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(texts):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return Counter((doc, len(sets[i]), least[root(i)] if doc is not None else None) for i, (doc, _) in enumerate(texts))


def test_near_duplicates_match_brute_force(spark, docs, texts):
    for percent, bits in ((80, 20), (50, 20), (80, 2)):
        out = near_duplicates(spark, docs, percent=percent, common_bits=bits).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out) == components_by_brute_force(texts, percent)


def test_near_duplicates_chain_and_border(spark):
    """Sets a..b..c where neighbours reach the threshold exactly and the ends do not link."""
    def text(lo, hi):
        return " ".join(f"t{i}" for i in range(lo, hi))

    rows = [(9, text(0, 49)), (5, text(5, 54)), (7, text(10, 59)), (3, text(200, 249))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(spark, df).collect()) == \
        components_by_brute_force(rows, 80) == Counter([(9, 45, 5), (5, 45, 5), (7, 45, 5), (3, 45, 3)])


def test_near_duplicates_on_no_rows(spark, no_docs):
    assert near_duplicates(spark, no_docs).collect() == []


def test_components_of_a_long_path(spark):
    links = spark.range(40).selectExpr("id + 1 AS x", "id AS y")
    assert {(r["node"], r["comp"]) for r in components(spark, links).collect()} == {(i, 0) for i in range(41)}


def test_a_long_passage_is_one_path(spark, monkeypatch):
    """200 common words in 40 documents, in two of them twice: paths that always follow each other are one row."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(200)]
    rows = [(d, " ".join([f"a{d}.{i}" for i in range(rng.randint(0, 70))] + passage + [f"b{d}.{i}" for i in range(rng.randint(60, 90))]
                         + (passage if d % 20 == 5 else []))) for d in range(40)]
    seen = []
    real = substring.long_paths
    monkeypatch.setattr(substring, "long_paths", lambda s, c: (seen.append((c.count(), real(s, c))), seen[-1][1])[1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark, docs).collect()}
    assert got == {d: 0 if d == 0 else 400 if d % 20 == 5 else 200 for d in range(40)}
    (parts, long), = seen
    edges = sorted(r.edges for r in long.collect())
    # what is left besides is where the passage meets the start or the end of a text
    assert parts > 4 and len(edges) <= 3 and edges[-1] > 80


def test_copies_of_a_very_long_text(spark):
    """Hundreds of paths in a row, over several rounds of doubling; the second copy ends early."""
    words = [f"w{i}" for i in range(9000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:8000])), (3, " ".join(words)), (4, " ".join(words[500:] + words[:500]))]
    got = {r.doc_id: r.n_removed for r in substring_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 8000, 3: 9000, 4: 9000}


def test_a_rule_may_condemn_many_good_documents():
    """Data that show it take a rule's accuracy on good documents far below its prior."""
    rng = np.random.default_rng(11)
    is_good = rng.random(40000) < 0.8
    g, b = np.array([0.99, 0.98, 0.99, 0.7]), np.array([0.6, 0.7, 0.65, 0.9])
    right = rng.random((len(is_good), 4)) < np.where(is_good[:, None], g, b)
    votes = np.where(right, 1, -1) * np.where(is_good, 1, -1)[:, None]
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    share, good, bad = fit_accuracies(patterns.astype(float), n.astype(float))
    assert abs(good - g).max() < 0.03 and abs(bad - b).max() < 0.05 and abs(share - 0.8) < 0.03


def test_posterior_and_verdict_match_a_plain_loop(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r.asDict() for r in quality_rules(spark, docs).collect()]
    names = [c for c in rows[0] if c.startswith("vote_")]
    seen = {}
    for r in rows:
        key = tuple(r[c] for c in names)
        seen[key] = seen.get(key, 0) + 1
    share, good, bad = fit_accuracies(np.array(list(seen), dtype=float), np.array(list(seen.values()), dtype=float))
    for r in rows:
        odds = share / (1 - share)
        for c, g, b in zip(names, good, bad):
            odds *= {1: g / (1 - b), -1: (1 - g) / b, 0: 1}[r[c]]
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert abs(r["quality"] - odds / (1 + odds)) < 1e-9 and r["base_failed"] == failed
        assert r["kept"] == (not failed and r["quality"] >= 0.5)
    assert len({r["kept"] for r in rows}) == 2
