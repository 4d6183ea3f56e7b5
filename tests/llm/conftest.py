import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, component string"


def corpus() -> list[tuple]:
    """Small documents with copies, near copies, shared passages and lines, and every odd case: (doc_id, text, lang, source, n_chars, size, component)."""
    rng = random.Random(5)
    word = lambda stem: stem + rng.choice("abcdefghij") + rng.choice("klmnopqrst") + str(rng.randrange(400))
    texts: list[str | None] = []
    passage, item = " ".join(word("p") for _ in range(70)), " ".join(word("q") for _ in range(30))
    base = [word("b") for _ in range(200)]
    for i in range(40):
        body = [word("w") for _ in range(rng.randrange(20, 160))]
        if i % 3 == 0:
            body[10:10] = passage.split()
        text = " ".join(body)
        if i % 4 == 0:
            text += "\nAll Rights  reserved. \n" + text[:30]
        texts.append(text)
    for i in range(8):  # near copies
        copy = list(base)
        for _ in range(i):
            copy[rng.randrange(200)] = word("x")
        texts.append(" ".join(copy))
    texts += [texts[1], texts[1], texts[2].upper(), "\t " + texts[3] + " \x0b"]  # copies
    texts += [" ".join(base[:100]) + " " + item + " tail", item]
    texts += [None, "", "  \n\t ", "one two three", "one two three", "Ä", "...", "a " * 120, " ".join(word("l") for _ in range(30_000)) + " " + passage]
    rows = [(i, t, "en" if i % 3 else "de", None if i % 11 == 0 else f"s{i % 4 if i % 2 else 0}", None, "x", "y") for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5]]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
