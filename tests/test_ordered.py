"""Running values and as-of joins over range partitions against plain Python, one hot key among them."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators.ordered import asof, numbered, running


def table(spark, n, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.randrange(n), i, rng.choice([None, rng.randrange(9)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t int, id int, v int").repartition(3)


@pytest.mark.parametrize("rows", [10_000, 40, 7])
def test_running_values(spark, rows):
    data, df = table(spark, 300, 1)
    order = [F.col("t"), F.col("id")]
    got = {r.id: r for r in running(df, ["k"], order, last={"l": F.col("v")}, previous={"p": F.col("v")}, total={"s": F.col("v"), "c": F.lit(1)}, highest={"h": F.col("v")}, rows=rows).collect()}
    assert len(got) == 300
    for k in {r[0] for r in data}:
        last = previous = total = most = None
        for n, (_, _, i, v) in enumerate(sorted((r for r in data if r[0] == k), key=lambda r: (r[1], r[2])), 1):
            previous, last = last, v if v is not None else last
            total = total if v is None else v + (total or 0)
            most = v if most is None else most if v is None else max(v, most)
            assert (got[i].l, got[i].p, got[i].s, got[i].c, got[i].h) == (last, previous, total, n, most)


def test_the_number_of_tasks_follows_the_rows(spark):
    hot = spark.range(4000).select(F.lit("all").alias("k"), F.col("id"))
    for n in (1000, 4000):
        got = numbered(hot.where(F.col("id") < n), ["k"], [F.col("id")], rows=100)
        assert got.where("n = id + 1").count() == n


@pytest.mark.parametrize("rows", [10_000, 30])
def test_asof_join(spark, rows):
    right, r = table(spark, 200, 2)
    left, l = table(spark, 250, 3)
    got = {x.id: x.found for x in asof(l, r.withColumnRenamed("id", "rid"), ["k"], ["t"], "found", rows=rows).collect()}
    assert len(got) == 250
    for k, t, i, _ in left:
        fits = [(b, -1 if v is None else v, j) for a, b, j, v in right if a == k and b <= t]
        found = got[i]
        if not fits:
            assert found is None
        else:
            assert (found.k, found.t) == (k, max(f[0] for f in fits))
            assert any(j == found.rid for b, _, j in fits if b == found.t)


def test_empty_tables(spark):
    _, df = table(spark, 20, 4)
    assert numbered(df.limit(0), ["k"], [F.col("id")]).count() == 0
    assert asof(df.limit(0), df, ["k"], ["t"], "f").count() == 0
    assert asof(df, df.limit(0), ["k"], ["t"], "f").where("f is null").count() == 20
