"""Which rows of buckets go on to be split: one sum tells buckets of one class and of one group from the rest."""

from veilframe.llm.jaccard import _counted


def test_buckets_of_one_group_are_done(spark):
    rows = spark.createDataFrame([(1, 10, 10), (2, 10, 10), (2, 11, 10), (3, 10, 10), (3, 12, 12), (3, 11, 10)], "key long, c long, g long")
    out = _counted(rows)
    assert sorted((r.key, r.c, r.g, r.size) for r in out.collect()) == [(3, 10, 10, 3), (3, 11, 10, 3), (3, 12, 12, 3)]
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.key, r.c, r.size) for r in _counted(rows.drop("g")).collect()) == [(2, 10, 2), (2, 11, 2), (3, 10, 3), (3, 11, 3), (3, 12, 3)]
