"""Small documents with everything a stage may meet: nulls, blanks, long texts, copies, clashing columns."""

import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, digest string, kept boolean, node long, times int, key string"


def words(rng, n, letters="abcdefghijklmnopqrst"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def make_docs(spark, texts, langs=None, sources=None, ids=None):
    rows = []
    for i, t in enumerate(texts):
        rows.append((ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"s{i % 3}", None, 7, 0.5, "x", None, 1, 3, "k"))
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    base = [words(rng, rng.randint(30, 120)) for _ in range(40)]
    near = []
    for t in base[:10]:  # copies with a word changed here and there
        w = t.split()
        for _ in range(rng.randint(1, 3)):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            near.append(" ".join(v))
    odd = [None, "", "  \n\t ", "one", "one", "two words", "A " * 3000, words(rng, 6000), "é ü ß 中文", base[0], base[0] + " ", base[0].upper()]
    return base + near + odd


@pytest.fixture(scope="session")
def docs(spark, prose):
    return make_docs(spark, prose).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], KIND)
