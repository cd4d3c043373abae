from __future__ import annotations

import random

import pytest

WORDS = ["the", "Quick", "brown,", "fox", "jumps", "over", "a", "lazy", "dog", "é", "漢字", "x1", "and", "of", "in"]


@pytest.fixture(scope="session")
def texts():
    """Texts with near and exact copies, shared passages, long and empty ones and nulls."""
    rng = random.Random(7)
    out: list[str | None] = [None, "", " \n\t ", "one", "two words", "two words", "Ümlaut"]
    passage = " ".join(rng.choice(WORDS) for _ in range(45))
    for n in range(40):
        body = [rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(rng.randint(3, 160))]
        if n % 4 == 0:
            body[len(body) // 2 : len(body) // 2] = passage.split()
        out.append(" ".join(body))
        for _ in range(n % 3):
            copy = list(body)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS) + "!"
            out.append("\n".join([" ".join(copy[:50]), " ".join(copy[50:])]))
    out.append(" ".join(rng.choice(WORDS) for _ in range(30_000)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id, text and columns whose names clash with what operators add."""
    rows = [(k * 3, t, "en", "s", None if t is None else len(t), "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token string").repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, token string")


@pytest.fixture(scope="session")
def bpe_file():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
