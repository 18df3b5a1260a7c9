import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, x long, copies int, digest string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, nulls, empties, one long text and odd characters."""
    rng = random.Random(5)
    passage = words(rng, 60)
    out = [None, "", " \t\n", "ok", "Two words", "ONE two three FOUR five", "one\ttwo  three four\nfive", "é ß ñ \u0000 日本", "a" * 5000, words(rng, 20_000)]
    for _ in range(40):
        base = words(rng, rng.randint(10, 150)).split(" ")
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = words(rng, 1)
            out.append(" ".join(near))
    out += [words(rng, 30) + " " + passage + " " + words(rng, 30) for _ in range(25)]
    out += ["\n".join([passage] * 3), passage, passage.upper(), passage.replace(" ", "  ")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rng = random.Random(6)
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "é", None]), len(t or ""), "k", i, 9, "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Repeated rows, and rows without an id."""
    rows = [(1, "same text here", "en", "s", 14, "k", 1, 1, "d")] * 2 + [(None, "no id", "en", "s", 5, "k", 1, 1, "d"), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)
