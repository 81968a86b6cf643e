"""Small tables with the hard cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like those that the operators work with.
CLASH = "doc_id long, text string, fp string, node int, mask int, name string, th int, dead string, quality string, component_id int, at int, `odd name` string"


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    r = random.Random(seed)
    names = ["".join(r2.choice("abcdefghilmnoprstu") for _ in range(r2.randint(2, 9))) for r2 in (random.Random(k) for k in range(vocabulary))]
    out = []
    for k in range(words):
        out.append(r.choice(names))
        if k % 9 == 8:
            out[-1] += "."
        if k % 27 == 26:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n") + "."


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def texts():
    base = [prose(k, 60 + k % 40) for k in range(40)]
    long = prose(99, 30_000)
    near = [base[0] + " tail", base[0] + " tails", base[1].replace(" a", " b", 1)]
    return base + [base[3], base[3], None, "", "   \n \t", "word", "two words", long, long + " end"] + near


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], "en", "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(spark, texts):
    rows = [(k, t, "x", 1, 2, "n", 3, "d", "q", 4, 5, "o") for k, t in enumerate(texts[:45])]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
