import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key int, score double"


def make_texts(seed: int = 3) -> list[tuple[int | None, str | None]]:
    """Copies, near copies, shared passages, repeated rows, null, empty, blank and long texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["Été", "naïve", "ß", "日本語", "don't", "a.b", "###"]

    def words(n):
        return [rng.choice(vocab) for _ in range(n)]

    base, passage = words(150), words(70)
    rows = [(i, " ".join(words(rng.randint(1, 160)))) for i in range(20)]
    rows += [(100 + i, " ".join(base)) for i in range(4)]
    for i in range(6):
        near = list(base)
        for _ in range(2):
            near[rng.randrange(len(near))] = f"edit{i}{rng.random()}"
        rows.append((200 + i, "\n".join(near) if i % 2 else "  ".join(near)))
    for i in range(5):
        rows.append((300 + i, " ".join(words(30) + passage + words(30))))
    rows += [(400, None), (401, ""), (402, " \t\n "), (403, "one two three"), (404, "One  two THREE"), (405, "one")]
    rows += [(500, " ".join(words(6000))), (501, "tok " * 3000), (502, " ".join(passage + passage))]
    rows += [(7, rows[7][1]), (100, " ".join(base)), (None, " ".join(base)), (None, None), (300, " ".join(words(80)))]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, ["en", "de", None][k % 3], f"src{k % 4}", len(t or ""), "x", 1, 0.5) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
