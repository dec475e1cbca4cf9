"""Small tables with the cases that every operator must bear."""

import random

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block int, row string, size long, `key` string, n long, d string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(spark, texts, start=0):
    rows = [(start + i, t, "en", f"src{i % 3}", None if t is None else len(t), 1, "x", 2, "k", 3, "d") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(spark, seed=5):
    """Null and empty texts, nulls in every column, a very long text, repeated rows, an unknown id, clashing names."""
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "one", prose(rng, 30_000), *[prose(rng, 60) for _ in range(12)]]
    d = documents(spark, texts)
    nulls = spark.createDataFrame([(None,) * 11, (None, "only text here", None, None, None, None, None, None, None, None, None)], SCHEMA)
    return d.union(d.where("doc_id in (5, 6)")).union(nulls)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
