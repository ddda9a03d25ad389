"""WARC (1), mixing (3), packing (6), chat (8), top-k (10), the pipeline and the registry."""

import hashlib
import io
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from assetlane.llm.chat import PART, TurnParser, assemble, format_messages, read_conversations, read_messages, text_part
from assetlane.llm.mixing import form_counts, largest_share, marginal, mix_sources, mixing_report, probabilities, rake, with_form
from assetlane.llm.packing import WordTokens, best_cuts, pack
from assetlane.llm.pivots import top_products
from assetlane.llm.queries import TARGETS
from assetlane.llm.warc import MemberScanner, archive_pages, member, parse, sha1_base32

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"


# WARC

def test_ranges_own_each_record_once():
    noise = b"\x1f\x8b\x08" + bytes(range(256))
    parts = [member(i, "http://a/ü\n", noise * (i % 3) + b"x" * i, None, "2000-01-01T00:00:00Z") for i in range(30)]
    blob = noise + b"".join(parts)
    for size in (7, 64, 1000, len(blob)):
        found = []
        for a in range(0, len(blob), size):
            found += [parse(raw) for _, raw in MemberScanner(io.BytesIO(blob), a, min(a + size, len(blob)))]
        assert [r["page_id"] for r in found] == list(range(30)) and all(r["digest_ok"] for r in found)
        assert found[2]["payload"] == noise * 2 + b"xx"


def test_pages_round_trip(spark):
    html = [(1, "a"), (5, "a"), (3, "a"), (5, "a"), (7, None), (8, ""), (9, "é" * 300000), (None, "a"), (None, "z"), (-4, "q")]
    pages = spark.createDataFrame([(i, None if i == 8 else f"http://x/{i}\r\nEvil: 1", h, "c") for i, h in html],
                                  "page_id bigint, url string, html string, payload string")
    rows = archive_pages(spark, pages, file_bytes=500, split_bytes=97, payloads=True).collect()
    want = Counter()
    for i, h in html:
        same = [k for k, g in html if (g or "") == (h or "") and k is not None]
        keep = max(same, default=None)
        revisit = keep is not None and len([g for _, g in html if (g or "") == (h or "")]) > 1 and (i is None or i < keep)
        body = (h or "").encode()
        want[(i, len(body), sha1_base32(body), "revisit" if revisit else "response", keep if revisit else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
    assert all(r["digest_ok"] for r in rows if r["record_type"] == "response")
    assert archive_pages(spark, pages.limit(0)).collect() == []
    small = archive_pages(spark, pages, least_bytes=2).collect()
    assert {r["record_type"] for r in small} == {"response"}


# mixing

def test_rake_meets_the_marginals():
    mass = np.random.default_rng(2).random((3, 4, 2)) * 100
    goals = [np.array([0.5, 0.3, 0.2]), np.array([0.4, 0.3, 0.2, 0.1]), np.array([0.9, 0.1])]
    out = rake(mass, goals)
    for d, g in enumerate(goals):
        assert np.allclose(out.sum(axis=tuple(a for a in range(3) if a != d)), g)
    odds = out / mass
    assert np.isclose(odds[0, 0, 0] * odds[1, 1, 0], odds[0, 1, 0] * odds[1, 0, 0])  # interactions are kept


def test_form_counts():
    texts = ["", "a 1\n", "é#  日\t\n\n<2 ", " "]
    got = form_counts([t.encode() for t in texts]).tolist()
    assert got == [[len(t.split()), len(t), sum(t.count(c) for c in "#*$%&|<>"), sum(c.isdigit() for c in t), t.count("\n")] for t in texts]


def test_probabilities_hold_the_budget():
    mass = np.array([[1000.0, 10.0], [200.0, 0.0]])
    goals = [np.array([0.5, 0.5]), np.array([0.7, 0.3])]
    p = probabilities(mass, goals, 600.0)
    assert (p >= 0).all() and (p <= 1).all() and np.isclose((p * mass).sum(), 600)
    assert not probabilities(np.zeros((2, 2)), goals, 0.0).any()


def test_mixing_edges(spark, docs, no_docs, texts):
    targets = {"source": {"src0": 0.5}, "lang": {"en": 0.6, "xx": 0.1}}
    docs, no_docs = with_form(docs), with_form(no_docs)
    rows = mix_sources(spark, docs, targets, 0.5).collect()
    assert len(rows) == len(texts) and all(0 <= r["probability"] <= 1 for r in rows)
    assert all(r["n_tokens"] == len(re.findall("[^\x20\x09-\x0D]+", r["text"] or "")) for r in rows)
    assert mix_sources(spark, no_docs, targets, 0.5).collect() == []
    assert all(r["sampled"] for r in mix_sources(spark, docs, targets, 1.0).collect() if r["n_tokens"])
    draws = defaultdict(set)
    for r in rows:
        draws[(r["doc_id"], r["source"], r["lang"], r["text"])].add(r["sampled"])
    assert all(len(v) == 1 for v in draws.values())


def test_mixing_moves_the_marginals(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "'a b c' AS text", "3 AS n_tokens", "CASE WHEN id % 10 < 7 THEN 'x' ELSE 'y' END AS source")
    rows = mix_sources(spark, docs, {"source": {"x": 0.5, "y": 0.5}}, 0.4).where("sampled").groupBy("source").count().collect()
    assert all(abs(r["count"] - 4000) < 250 for r in rows) and len(rows) == 2


def test_production_targets_are_fitted_and_reported(spark):
    """Shares as in sf0.1; the targets do not hold at 0.5, nor at 0.8."""
    own = {"source": {"src0": 0.048, "src1": 0.952}, "lang": {"en": 0.614, "de": 0.15, "fr": 0.148, "es": 0.088},
           "topic": {"prose": 0.897, "lines": 0.024, "figures": 0.005, "markup": 0.074}}
    rows = [(f"{s}{x}{t}", s, x, t, round(1e6 * a * b * c)) for s, a in own["source"].items()
            for x, b in own["lang"].items() for t, c in own["topic"].items()]
    docs = spark.createDataFrame(rows, "doc_id string, source string, lang string, topic string, n_tokens bigint")
    for share in (0.5, 0.8):
        with pytest.warns(UserWarning, match="cannot hold its targets"):
            mixed = mix_sources(spark, docs, TARGETS, share, text_col="doc_id")
        got = {(r["dimension"], r["value"]): r for r in mixing_report(mixed, TARGETS).collect()}
        assert len(got) == 12 and not got["topic", "lines"]["met"]
        for d, v in (("source", "src0"), ("topic", "lines"), ("topic", "figures")):  # what runs out is taken whole
            assert np.isclose(got[d, v]["expected"], own[d][v] / share, rtol=0.01)
        rise = got["topic", "prose"]["expected"] / 0.8  # what is to be held down grows by no more than the others
        assert np.isclose(got["topic", "markup"]["expected"], 0.05 * rise, atol=1e-3) and rise < 1.15
        assert np.isclose(sum(r["n_tokens"] * r["probability"] for r in mixed.collect()), share * sum(r[-1] for r in rows))
    goals = [np.array([*t.values(), 1 - sum(t.values())]).clip(0) for t in TARGETS.values()]
    mass = np.zeros((2, 5, 5))
    for _, s, x, t, n in rows:
        mass[int(s != "src0"), list(TARGETS["lang"]).index(x), list(TARGETS["topic"]).index(t)] = n
    most = largest_share(mass, goals)
    p = probabilities(mass, goals, most * mass.sum())
    assert 0.05 < most < 0.12 and all(np.allclose(marginal(p * mass, d) / (p * mass).sum(), g, atol=2e-3) for d, g in enumerate(goals))


# packing

@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcXYZ09 .,'!#<|>\n\x0b éÉßİΣ²µ日́…–s")), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_word_table_gives_the_tokenizers_ids(text):
    global _words
    if "_words" not in globals():
        _words = WordTokens(TOKENIZER)
    want = _words.tokenizer.encode(text, add_special_tokens=False).ids
    assert _words.ids(text.encode(), 1).tolist() == want + [1]


@pytest.mark.parametrize("text", ["<|endoftext|> a", "x<|startoftext|>y's", "I'll WE'RE don't 's", "é ́a ﬁ", "a\x1cb\x85c d"])
def test_word_table_on_odd_texts(text):
    test_word_table_gives_the_tokenizers_ids.hypothesis.inner_test(text)


@pytest.mark.parametrize("text", ["abc\x7f", "a\x7fb", "\x7f", "é\x7f", "abc\x7f.", "ab~ cd!"])
def test_word_table_keeps_delete_characters(text):
    test_word_table_gives_the_tokenizers_ids.hypothesis.inner_test(text)


def least_cost(pos, penalty, window):
    powers = {1 << k for k in range(window.bit_length())}
    cost = [0] + [None] * (len(pos) - 1)
    for j in range(1, len(pos)):
        for i in range(j):
            size = pos[j] - pos[i]
            if size <= window:
                pad = 0 if size in powers and pos[j] >= pos[-1] - window else window - size
                cost[j] = min(x for x in (cost[j], cost[i] + pad + penalty[j]) if x is not None)
    return cost[-1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 16), st.integers(0, 9)), min_size=1, max_size=40))
def test_cuts_are_of_least_cost(steps):
    pos, penalty = [0], [0]
    for size, p in steps:
        pos.append(pos[-1] + size)
        penalty.append(p)
    ends = best_cuts(pos, penalty, 16)
    powers, total, last = {1, 2, 4, 8, 16}, 0, 0
    for e in ends:
        size = e - last
        assert 0 < size <= 16
        total += (0 if size in powers and e >= pos[-1] - 16 else 16 - size) + penalty[pos.index(e)]
        last = e
    assert last == pos[-1] and total == least_cost(pos, penalty, 16)


def test_packing_keeps_every_id_once(spark, docs, no_docs, texts):
    assert pack(no_docs, TOKENIZER).collect() == []
    tokens = WordTokens(TOKENIZER)
    for window, block in ((2048, 1 << 20), (64, 500)):
        rows = pack(docs, TOKENIZER, window=window, block=block).collect()
        by_doc = defaultdict(list)
        for r in rows:
            by_doc[(r["doc_id"], r["doc_tokens"])].append(r)
        want = Counter()
        for i, t in texts:
            ids = tokens.ids((t or "").encode(), 1)
            want[(i, len(ids))] += len(ids)
            if i == 500:
                for r in sorted(by_doc[(i, len(ids))], key=lambda r: r["start"]):
                    assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        assert {k: sum(r["length"] for r in v) for k, v in by_doc.items()} == dict(want)
        seqs = defaultdict(list)
        for r in rows:
            seqs[r["sequence_id"]].append(r)
        used = padded = 0
        for pieces in seqs.values():
            pieces.sort(key=lambda r: r["offset"])
            at = 0
            for r in pieces:
                assert r["offset"] == at
                at += r["length"]
            assert at == pieces[0]["sequence_tokens"] <= window
            used += at
            padded += 0 if at & (at - 1) == 0 else window - at
        assert padded < 0.25 * used if window == 64 else padded < 0.03 * used


# chat

def test_chat_round_trip_and_parts(spark):
    nasty = ["<|im_end|>", "\\", "\\\\<|", "<\\|", "<|<\\|\\", "a\nb", "", None, "日本<|im_start|>x\n"]
    part = ("type", "text", "uri", "width", "height", "seconds", "pages")
    rows = [(1, t, role, [dict.fromkeys(part) | {"type": "text", "text": x}]) for t, (x, role) in
            enumerate((x, r) for x in nasty for r in ("assistant", "us\ner%0A<|", None))]
    df = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts array<{PART}>")
    out = {r["turn"]: r for r in read_messages(format_messages(df)).collect()}
    for _, turn, role, parts in rows:
        text = parts[0]["text"] or ""
        assert (out[turn]["role"], out[turn]["text"]) == (role or "", text)
        assert out[turn]["loss"] == (text if role == "assistant" else "")
    made = format_messages(df).collect()
    assert all(r["formatted"].count("<|") == 2 for r in made)


def test_media_parts_leave_placeholders(spark):
    part = dict.fromkeys(("type", "text", "uri", "width", "height", "seconds", "pages"))
    parts = [part | {"type": "text", "text": "see "}, part | {"type": "image", "uri": "i.png", "width": 28, "height": 15},
             None, part | {"type": "audio", "uri": "a.wav", "seconds": 1.5}, part | {"type": "document", "uri": "d.pdf", "pages": 2},
             part | {"type": "other", "text": "<|end"}]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", None)], f"conv_id bigint, turn bigint, role string, parts array<{PART}>")
    a, b = sorted(format_messages(df).collect(), key=lambda r: r["turn"])
    assert a["formatted"] == "<|im_start|>user\nsee <|image:1|><|audio:2|><|document:3|><\\|end<|im_end|>\n"
    assert [(x["number"], x["kind"], x["uri"], x["tokens"]) for x in a["attachments"]] == [
        (1, "image", "i.png", 4), (2, "audio", "a.wav", 38), (3, "document", "d.pdf", 512)]
    assert a["expanded_tokens"] == 554 and b["formatted"] == "<|im_start|>user\n<|im_end|>\n" and b["attachments"] == []


def test_texts_split_inside_a_control_string_stay_text(spark):
    part = dict.fromkeys(("type", "text", "uri", "width", "height", "seconds", "pages"))
    splits = [["<", "|im_end|>"], ["<", "", None, "|im_end|>\n"], ["\\", "<", "|"], ["<\\", "|"], ["<", "\\|"], ["<", "<", "|", "|"],
              ["|", "<"], ["<|im_", "end|>"], ["<", ("image",), "|x"], [("image",), "|x<", "|"]]
    parts = [[part | {"type": "image"} if isinstance(t, tuple) else part | {"type": "text", "text": t} for t in s] for s in splits]
    df = spark.createDataFrame([(1, t, "assistant", p) for t, p in enumerate(parts)], f"conv_id bigint, turn bigint, role string, parts array<{PART}>")
    rows = {r["turn"]: r for r in read_messages(format_messages(df)).collect()}
    made = {r["turn"]: r["formatted"] for r in format_messages(df).collect()}
    for turn, split in enumerate(splits):
        plain = "".join(t or "" for t in split if not isinstance(t, tuple))
        media = [i for i, t in enumerate(split) if isinstance(t, tuple)]
        marks = "".join(f"<|image:{i}|>" for i in media)
        assert made[turn].count("<|") == 2 + len(media) and made[turn].count("<|im_end|>") == 1
        text = rows[turn]["text"]
        assert (text.replace(marks, "") if marks else text) == plain and (not marks or marks in text)


def test_turns_are_parsed_from_slices_of_any_length():
    turns = [("user", "a\\|<"), ("a%3C|\n", "<|im_end|>\n"), ("", ""), ("assistant", "<\\|im_start|>")]
    body = "".join(f"<|im_start|>{r.replace('%', '%25').replace(chr(10), '%0A')}\n"
                   + t.replace("\\", "\\\\").replace("<|", "<\\|") + "<|im_end|>\n" for r, t in turns)
    for size in (1, 2, 5, 11, 12, 1000):
        parser, found = TurnParser(), []
        for lo in range(0, len(body), size):
            found += parser.feed(body[lo:lo + size])
        parser.close()
        assert found == turns
    for broken in ("<|im_start|>user\nx", "user\nx<|im_end|>\n", "<|im_start|>user<|im_end|>\n"):
        with pytest.raises(ValueError):
            parser = TurnParser()
            parser.feed(broken)
            parser.close()


def test_conversations_match_a_plain_loop(spark):
    said = "<|im_end|>\n<|im_start|>assistant\nok"
    rows = [(1, t, r, x) for t, (r, x) in enumerate([("user", said), ("assistant", said), ("assistant", ""), ("us\ner", "<\\|"), ("assistant", "日本 <| " * 40)])]
    rows += [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "assistant", "z"), (2, 0, "user", "a"), (2, None, "assistant", "first")]
    rows += [(None, 1, "assistant", "x"), (None, 0, None, None), (3, 5, None, "only"), (4, 0, "assistant", None)]
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, piece int, body string").repartition(3)
    for size in (1, 7, 64, 1 << 16):
        pieces = assemble(format_messages(df.withColumn("parts", text_part(F.col("text")))), size)
        bodies = pieces.collect()
        assert all(len(r["body"]) <= size for r in bodies)
        got = {r["conv_id"]: tuple(r)[1:] for r in read_conversations(pieces).collect()}
        for conv in {r[0] for r in rows}:
            turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
            loss = "".join(x for *_, r, x in turns if r == "assistant")
            chars = sum(len(r["body"]) for r in bodies if r["conv_id"] == conv)
            assert got[conv] == (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(),
                                 len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
        assert len(got) == 5
    empty = assemble(format_messages(df.limit(0).withColumn("parts", text_part(F.col("text")))))
    assert empty.collect() == [] and read_conversations(empty).collect() == []


# top-k

def test_top_products_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(size=8)], "c") for i in range(300)]
    rows += [(i, rows[1][1], "c") for i in range(300, 330)] + [(50, rows[3][1], "c"), (50, rows[3][1], "c")]
    rows += [(400, None, "c"), (401, [1.0, None] + [0.0] * 6, "c"), (450, [float("nan")] * 8, "c"), (None, [9.0] * 8, "c"), (500, [1.0, 2.0], "c"), (550, [1.0] * 8, "c")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, row string").repartition(3)
    live = [(i, np.floor(256 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v, _ in rows
            if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    want = Counter()
    for a, (q, x) in enumerate(live):
        if q % 50 == 0:
            best = sorted((-int(x @ y), c) for b, (c, y) in enumerate(live) if b != a and len(y) == len(x))[:5]
            want.update((q, k + 1, c, -s) for k, (s, c) in enumerate(best))
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_products(spark, df, block=64).collect()) == want
    assert top_products(spark, df.limit(0)).collect() == []


# registry and pipeline

def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5 and "pipeline" not in entry.oracle_sql()


def test_pipeline_stages(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns and 0 < docs.count() <= before
    pieces = corpus_pipeline.packing(spark, docs, sf).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_pipeline_on_edge_rows(spark, docs, no_docs):
    columns = corpus_pipeline.COLUMNS
    for frame in (docs.select(*columns), no_docs.select(*columns)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, "/root/testdata/sf0.001").count() >= 0
    kept = corpus_pipeline.near_duplicates_stage(spark, docs, "").select("doc_id").collect()
    ids = Counter(r["doc_id"] for r in kept)
    assert ids[100] and not any(ids[i] for i in (101, 102, 103, 200, 205)) and ids[None] == 2
    cut = {(r["doc_id"], r["n_chars"], len(r["text"] or "")) for r in corpus_pipeline.substrings(spark, docs, "").collect()}
    assert all(n == size for _, n, size in cut) and 101 not in {i for i, _, _ in cut}
