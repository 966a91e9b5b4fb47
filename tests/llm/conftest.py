import os
import random

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tok():
    import public_tokenizers

    return public_tokenizers.path


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """doc_id, text: exact and near copies, a shared passage, short, blank, null and long texts."""
    rng, out = random.Random(5), []
    base = words(rng, 60).split()
    for k in range(40):  # a chain of near copies
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(60)] = f"x{rng.randrange(99)}"
        out.append(" ".join(copy))
    passage = words(rng, 30)
    out += [f"{words(rng, 8)} {passage} {words(rng, 5)}" for _ in range(30)]
    out += ["same text over and over again"] * 12 + ["a b", "A B", "a  b", "", "   \n ", None, None, "solo"]
    out += [words(rng, 40) for _ in range(30)] + [words(rng, 6000)]
    ids = rng.sample(range(10_000), len(out))
    return list(zip(ids, out))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "en", k % 3, f"k{k}") for k, (i, t) in enumerate(corpus)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, sid long, key string").repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA
