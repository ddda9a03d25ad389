"""Held-out accuracy and defined edge cases of the classifiers (4, 7)."""

import numpy as np
from pyspark.sql import functions as F

from assetlane.llm.quality_mil import Attention, encode, fit, quality_scores, train, whole_rows
from assetlane.llm import toxicity
from assetlane.llm.toxicity import toxicity_scores

LABELS = "doc_id bigint, quality int, toxic int, lang string"


def accuracy(rows, truth):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]), held


def read(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, labels.collect()


def test_quality_on_held_out_documents(spark):
    docs, labels, known = read(spark, "/root/testdata/sf0.01")
    rows = quality_scores(spark, docs, labels).collect()
    share, held = accuracy(rows, {r["doc_id"]: r["quality"] for r in known if r["quality"] is not None})
    assert len(held) > 50 and share > 0.95
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_on_held_out_documents(spark):
    docs, labels, known = read(spark, "/root/testdata/sf0.1")
    truth = {r["doc_id"]: r["toxic"] for r in known if r["toxic"] is not None}
    share, held = accuracy(toxicity_scores(spark, docs, labels).collect(), truth)
    toxic = [r["predicted"] for r in held if truth[r["doc_id"]] == 1]
    assert share > 0.97 and np.mean(toxic) > 0.85


def test_held_out_labels_are_not_learned(spark):
    docs, labels, _ = read(spark, "/root/testdata/sf0.001")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality",
                                "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    for scores in (quality_scores, toxicity_scores):
        a, b = ({(r["doc_id"], round(r["score"], 9)) for r in scores(spark, docs, x).collect()} for x in (labels, flipped))
        assert a == b


def test_edge_rows_and_missing_labels(spark, docs, no_docs, texts):
    none = spark.createDataFrame([], LABELS)
    odd = spark.createDataFrame([(None, 1, 1, "x"), (1, None, None, "x"), (1, 0, 1, "x"), (2, 1, 0, "x"), (2, 1, 0, "x"), (99999, 0, 1, "x")], LABELS)
    for scores in (quality_scores, toxicity_scores):
        assert scores(spark, no_docs, odd).collect() == []
        for labels in (none, odd):
            rows = scores(spark, docs, labels).collect()
            assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)
            assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
            by_text = {}
            for r in rows:
                if r["doc_id"] == 7:
                    by_text.setdefault(r["doc_id"], set()).add(r["score"])
            assert all(len(v) == 1 for v in by_text.values())


def test_quality_learns_from_every_passage(spark):
    """Labels that rest on one passage among hundreds, at places an even choice of 96 would miss."""
    rng = np.random.default_rng(5)
    plain = " ".join(["plain", "words", "of", "prose", "here"] * 13)[:330].split()[:64]
    junk = ["#$%&*"] * 64
    rows, labels = [], []
    for i in range(40):
        bag = [plain] * 301
        if i % 2 == 0:
            bag = bag[:1 + 3 * int(rng.integers(1, 90)) + 1] + [junk] * 2 + bag[:20]
        rows.append((i, " ".join(" ".join(p) for p in bag)))
        labels.append((i, 1 - (i % 2 == 0), 0, "en"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marked = spark.createDataFrame(labels, LABELS)
    model = train(docs.withColumn("text", F.col("text").cast("binary")), marked, F.lit(True))
    bags = [encode([t.encode()])[0] for _, t in rows]
    want = fit([bags[i] for i in range(40)], np.array([float(q) for _, q, *_ in labels]))
    assert all(np.allclose(model.p[k], want.p[k], atol=1e-6) for k in model.p)
    assert len(bags[1]) == 301


def test_features_do_not_depend_on_the_other_texts():
    texts = [b"a b a b a b", b"a b a", b"", b"b a", b"a b a b"]
    x, first = encode(texts)
    for i, text in enumerate(texts):
        assert np.array_equal(x[first[i]:first[i + 1]], encode([text])[0])


def test_rows_are_taken_whole_until_the_bytes_are_reached(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(10)] + [(3, "y" * 5), (4, None)], "doc_id bigint, text string")
    sample = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, label int")
    sizes = {i: 100 + 5 * (i == 3) for i in range(10)}
    for bound in (1, 100, 250, 10 ** 6):
        taken = [r["doc_id"] for r in whole_rows(docs, sample, bound).collect()]
        total = sum(sizes[i] for i in taken)
        assert len(taken) == 10 if bound > 1005 else bound <= total < bound + 106


def test_scores_match_a_plain_loop(spark):
    docs, labels, _ = read(spark, "/root/testdata/sf0.001")
    texts = docs.selectExpr("doc_id", "CAST(text AS BINARY) AS text")
    p = (model := train(texts, labels, F.expr("crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 <> 1"))).p
    got = {r["doc_id"]: r["score"] for r in quality_scores(spark, docs, labels).collect()}
    for row in texts.collect():
        x = np.clip((encode([bytes(row["text"] or b"")])[0] - model.mean) / model.scale, -8, 8)
        r = [np.tanh(v @ p["E"] + p["e"]) for v in x]
        e = np.array([np.tanh(v @ p["V"]) * (1 / (1 + np.exp(-(v @ p["U"])))) @ p["w"] for v in r])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
        z = sum(w * v for w, v in zip(a, r)) @ p["c"] + p["b"][0]
        assert abs(got[row["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-6


def test_attention_gradient_is_the_slope():
    x, first = encode([b"a b c " * 40, b"", b"X!! Y!! " * 70])
    model = Attention(x.mean(axis=0), x.std(axis=0) + 1e-3)
    rng = np.random.default_rng(1)
    model.p["c"] = rng.normal(size=len(model.p["c"]))
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        z = model.forward(x, first)[-1]
        return float((np.logaddexp(0, z) - y * z).mean())

    slopes = model.gradient(x, first, y, 0.0)
    for name, value in model.p.items():
        flat = value.reshape(-1)
        for i in rng.integers(0, len(flat), 3):
            keep = flat[i]
            flat[i] = keep + 1e-5
            up = loss()
            flat[i] = keep - 1e-5
            down = loss()
            flat[i] = keep
            assert abs((up - down) / 2e-5 - slopes[name].reshape(-1)[i]) < 1e-5


def test_slots_are_chosen_as_a_plain_loop_does(spark):
    docs, labels, known = read(spark, "/root/testdata/sf0.01")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.select("doc_id", "text").collect()}
    toxic = {r["doc_id"] for r in known if r["toxic"] == 1}
    rows, seen = [], {0: {}, 1: {}}
    for doc, text in texts.items():
        slot, count, _ = toxicity.slots([text])
        label = int(doc in toxic)
        rows.append((doc, label, bytearray(np.stack([slot, count], axis=1).astype(np.int32).tobytes())))
        for s in slot.tolist():
            seen[label][s] = seen[label].get(s, 0) + 1
    stored = spark.createDataFrame(rows, "doc_id bigint, label int, x binary").repartition(3)
    n1, n0 = len(toxic & set(texts)), len(set(texts) - toxic)
    score = {}
    for s in set(seen[0]) | set(seen[1]):
        p, u = seen[1].get(s, 0), seen[0].get(s, 0)
        rate = (u + p + 1) / (n0 + n1 + 2)
        score[s] = (p - n1 * rate) / np.sqrt(n1 * rate * (1 - rate) + 1)
    best = sorted(score, key=lambda s: (-score[s], s))[:64]
    want = [s for s in best if score[s] > 2 and seen[1].get(s, 0) >= 3]
    chosen = toxicity.choose(toxicity.document_counts(stored), n1, n0, 64)
    assert len(want) > 3 and chosen.tolist() == want
    for r in toxicity.chosen_counts(stored, chosen).collect():
        slot, count, _ = toxicity.slots([texts[r["doc_id"]]])
        have = dict(zip(slot.tolist(), count.tolist()))
        pairs = np.frombuffer(r["x"], dtype=np.int32).reshape(-1, 2).tolist()
        assert {want[at]: c for at, c in pairs} == {s: have[s] for s in want if s in have}


def test_toxicity_scores_match_a_plain_loop(spark):
    docs, labels, known = read(spark, "/root/testdata/sf0.01")
    texts = docs.selectExpr("doc_id", "CAST(text AS BINARY) AS text")
    model = toxicity.train(spark, texts, labels, 5, 0)
    got = {r["doc_id"]: r["score"] for r in toxicity_scores(spark, docs, labels).collect()}
    for row in texts.collect():
        slot, count, _ = toxicity.slots([bytes(row["text"] or b"")])
        z = model.bias + sum(float(model.weight[s]) * np.log1p(c) for s, c in zip(slot, count))
        assert abs(got[row["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-6
