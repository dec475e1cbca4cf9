"""Running values within keys, and the as-of join, for keys that may hold a third of all rows.

A window over a key reads the key in one task. Here rows are cut into range partitions of (keys, order), as many as the
number of rows asks for, at bounds that Spark samples; a partition's rows follow those of the one before. Within each
partition a window gives the value, from earlier partitions of the key a carry: one row for each key and partition is
summed up, and its running value joined back. So a key of any size is read by as many tasks as its rows need. Tables of
one range need no cut.

Null keys are equal to each other. Order must tell rows of a key apart where the result depends on it. Empty tables give
no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize

#: Rows of a range partition, about.
ROWS = 1 << 20


def running(
    df: DataFrame, keys: list[str], order: list[Column | str], last: dict[str, Column | str] = {}, previous: dict[str, Column] = {}, total: dict[str, Column] = {}, highest: dict[str, Column] = {}, rows: int | None = None
) -> DataFrame:
    """df with the running values of its rows' keys in order: last (the last value that isn't null, up to the row), previous (the same up to the row before), total and highest (the sum and the maximum, up to the row). Columns of df given by name aren't written and shuffled twice."""
    values = {**last, **previous, **total, **highest}
    o = [c if isinstance(c, str) else f"_o{i}" for i, c in enumerate(order)]
    v = {name: c if isinstance(c, str) else f"_v_{name}" for name, c in values.items()}
    made = [c.alias(n) for c, n in [*zip(order, o, strict=True), *((c, v[name]) for name, c in values.items())] if not isinstance(c, str)]
    t = materialize(df.select("*", *made), "ordered")
    parts = -(-t.count() // (rows or ROWS))

    def joined(name: str) -> Callable[[Column], Column]:
        return F.sum if name in total else F.max if name in highest else lambda x: F.last(x, ignorenulls=True)

    def within(w, name: str) -> Column:
        up_to = w.rowsBetween(Window.unboundedPreceding, -1 if name in previous else Window.currentRow)
        return joined(name)(F.col(v[name])).over(up_to)

    if parts <= 1:
        w = Window.partitionBy(*keys).orderBy(*o)
        return t.select(*[F.col(f"`{c}`") for c in df.columns], *[within(w, name).alias(name) for name in values])
    t = materialize(t.repartitionByRange(parts, *keys, *o).withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_part", *keys).orderBy(*o)
    t = t.select("*", *[within(w, name).alias(f"_w_{name}") for name in values])

    def whole(name: str) -> Column:
        x = F.col(v[name])
        return (F.max_by(x, F.when(x.isNotNull(), F.struct(*o))) if name in last or name in previous else joined(name)(x)).alias(name)

    ends = t.groupBy("_part", *keys).agg(*[whole(name) for name in values])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[joined(name)(F.col(name)).over(before).alias(f"_c_{name}") for name in values],
    )
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))

    def result(name: str) -> Column:
        own, carried = F.col(f"_w_{name}"), F.col(f"_c_{name}")
        both = own + carried if name in total else F.greatest(own, carried) if name in highest else own
        return F.coalesce(both, own, carried).alias(name)

    return t.join(carry, same).select(*[F.col(f"`{c}`") for c in df.columns], *[result(name) for name in values])


def asof(left: DataFrame, right: DataFrame, keys: list[str], order: list[str], name: str, rows: int | None = None) -> DataFrame:
    """left with name: the last row of right, as a struct, of equal keys that doesn't come after it; null where there is none.

    order: columns of both sides, by which rows of a key are ordered; a row of right comes before one of left that is
    equal in all of them. Rows of right that are equal in all of them are ordered by their other columns.
    """
    columns = [c for c in left.columns if c != name]
    # what both sides are ordered by stands beside the structs, and isn't held in them again
    held = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in columns if c not in keys and c not in order])
    given = F.struct(*[F.col(f"`{c}`") for c in right.columns if c not in keys])
    same = [F.col(c) for c in [*keys, *order]]
    mine = left.select(*same, held.alias("_left"), F.lit(None).cast(right.select(given.alias("x")).schema["x"].dataType).alias("_right"), F.lit(1).alias("_side"))
    theirs = right.select(*same, F.lit(None).cast(mine.schema["_left"].dataType).alias("_left"), given.alias("_right"), F.lit(0).alias("_side"))
    out = running(mine.unionByName(theirs), keys, [*order, "_side", "_right"], last={"_found": "_right"}, rows=rows)
    own = [(F.col(c).cast(left.schema[c].dataType) if c in keys or c in order else F.col(f"_left.`{c}`")).alias(c) for c in columns]
    found = F.struct(*[(F.col(c).cast(right.schema[c].dataType) if c in keys else F.col(f"_found.`{c}`")).alias(c) for c in right.columns])
    return out.where("_side = 1").select(*own, F.when(F.col("_found").isNotNull(), found).alias(name))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "n", rows: int | None = None) -> DataFrame:
    """df with name: the place of a row among its keys' by order, from 1."""
    return running(df, keys, order, total={name: F.lit(1).cast("long")}, rows=rows)
