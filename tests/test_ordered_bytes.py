"""What the as-of join writes: nothing twice."""

from veilframe.operators import ordered


def test_asof_writes_no_column_twice(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordered, "materialize", lambda df, name, real=ordered.materialize: seen.append(df.schema) or real(df, name))
    left = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), (None, 5, "z")], "k string, t int, v string")
    right = spark.createDataFrame([("a", 2, "p"), (None, 5, "q"), ("a", 2, "o")], "k string, t int, w string")
    out = ordered.asof(left, right, ["k"], ["t"], "m").collect()
    assert sorted((r.v, r.m and tuple(r.m)) for r in out) == [("x", ("a", 2, "p")), ("y", None), ("z", (None, 5, "q"))]
    assert seen[0].names == ["k", "t", "_left", "_right", "_side"]
