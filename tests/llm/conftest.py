import random

import pytest


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Small documents with near copies, exact copies, ties, null and empty texts,
    secrets, a long text and a hot source: (doc_id, text, lang, source, n_chars)."""
    rng, rows = random.Random(5), []
    base = [words(rng, rng.randint(1, 300)) for _ in range(40)]
    for i in range(160):
        t = base[i % 40]
        if i >= 40 and i % 3:
            w = t.split()
            w[rng.randrange(len(w))] = "zz%d" % i
            t = " ".join(w)
        if i % 11 == 0:
            t += " password=\"abcDEF123456\" token: deadbeefdeadbeefdeadbeef00 Api_Key = 'x' AKIA%s é" % ("Q" * (10 + i % 12))
        rows.append((i, t, "en", "src%d" % (0 if i % 3 == 0 else i % 23), len(t)))
    rows += [(200, None, None, None, None), (201, "", "en", "src1", 0), (202, " \n\t ", "en", "src2", 4), (203, words(rng, 9000) + "\nÉé ß", "de", "src0", 1),
             (204, "A b C", "en", "nowhere", 5), (205, "a B c", "en", "src3", 5), (205, "a B c", "en", "src3", 5)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
