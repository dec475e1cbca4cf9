"""Texts made to be slow: every pattern takes time in proportion to their length, and none overflows the matcher's stack."""

import re
import time

import pytest
from pyspark.sql import functions as F

from veilframe.functions.patterns import ALIAS, DETECTORS
from veilframe.functions.spans import INNER, MARK, find_all

UNITS = ["a.", "a", "1", "1.", "1-", "1 ", "1,", "@", "a@", "+1 ", "(", "_", "a_", "eyJ", "eyJ-", "eyJaaaaaaaa.", "Bearer ", "api_key", "sk-live-", "AB12", "1/", ":", "a:", "::", "é.", "$1,", "1.1,", "www."]
PATTERNS = {f"{d.kind}{d.order}": d.pattern for d in DETECTORS} | {"ALIAS": ALIAS}


@pytest.mark.parametrize("name", sorted(PATTERNS))
def test_patterns_are_linear(spark, name):
    java = spark.sparkContext._jvm.java.util.regex.Pattern.compile(PATTERNS[name])
    for unit in UNITS:
        text = "@ " + unit * (100_000 // len(unit.encode())) + " 12@"
        start = time.time()
        java.matcher(text).replaceAll("x")
        assert time.time() - start < 1.5, unit


CASES = [
    "éa@b.co a.@b.co .a@b.co a@b.com.x@y.co a@b a.b.c@d.e.fg, x@y.zz.", "éa.b@x.co %a@b.co a@b.co@c.de", "$1.000,1.25 USD 1,2,3.45 EUR .1,2.30 GBP $1,000.5 and 9.99INR 1,1.00 USD 12.34.56 EUR", "eyJaaaaaaaa.bbbbbbbb.cccccccc eyJeyJaaaaaaaaa.bbbbbbbb.cccccccc- x-eyJaaaaaaaa.bbbbbbbb.cccccccc eyJa-eyJbbbbbbbb.cccccccc.dddddddd",
    "a" * 70 + "." + "b" * 70 + "@c.de", "1," * 50 + "2.50 USD",
]


@pytest.mark.parametrize("d", [d for d in DETECTORS if d.plain], ids=lambda d: d.kind)
def test_linear_patterns_find_what_the_plain_ones_do(spark, d):
    java = spark.sparkContext._jvm.java.util.regex.Pattern
    import random

    rng = random.Random(7)
    alphabet = {"EMAIL": "ab.@-%é _Z1", "KEY": ["eyJ", "aaaaaaaa", "b", ".", "-", " ", "_"], "MONEY": ["1", "23", ",", ".", " ", "$", "USD", "a", ".50"]}[d.kind]
    texts = CASES + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    fast, plain = java.compile(d.pattern), java.compile(d.plain)
    joined = "\n".join(texts)
    assert fast.matcher(joined).replaceAll("<$0>") == plain.matcher(joined).replaceAll("<$0>")


def test_finds_of_texts_that_hold_the_marks(spark):
    texts = [f"a{MARK}b x@y.zz {INNER} q@r.st", MARK * 3 + "x@y.zz", "", None, "none", "x@y.zz"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", find_all(F.col("t"), r"[a-z]+@[a-z.]+[a-z]").alias("f")).orderBy("i").collect()
    want = [[(m.start(), m.end(), m[0]) for m in re.finditer(r"[a-z]+@[a-z.]+[a-z]", t)] if t is not None else None for t in texts]
    assert [None if r["f"] is None else [tuple(x) for x in r["f"]] for r in got] == want
