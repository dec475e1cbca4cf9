"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

Each source's documents, in an order drawn by a keyed hash, form a stream of words that is repeated up to three times;
the mix takes the first target words of it. The stream is cut into blocks of a fixed number of words (the last may be
shorter). All sources' blocks are dealt to output shards: a binary tree halves the shards, and at each node the number
of blocks of each source that go left is drawn from the multivariate hypergeometric distribution given the left half's
capacity, so every shard is what a shuffle of all blocks would have given it, and the quotas are exact. A source's
blocks are numbered anew by a keyed permutation; a shard takes the run of numbers that the tree allots to it, so shards
are disjoint; within a shard, blocks are ordered by hash.

Weights 5, 2, 1 repeat over the sources by code point, null last. A target stops at repeats times its source's size;
the excess is shared anew by weight: with L the level at which all is given out, target = min(cap, L * weight).

Null and empty texts have size 0 and take nothing. Rows that repeat an id are mixed each for itself. Equal hashes are
ordered by id. An empty table gives no rows. Other columns aren't read.

The tree's rows are nodes with one count per source: the number of sources must fit in a row. No rows but those tables
of sources, of (source, bucket) sums and of shards are brought together, and none reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, docs_table, materialize

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Words in a block.
BLOCK = 2048
#: Blocks in a shard, about; the number of shards is a power of two.
SHARD = 256
#: Sub-streams of a source, whose sums are prefix-summed before their documents are.
BUCKETS = 4096
#: Steps of the permutation, fixed primes; one that doesn't divide the number of blocks is used.
STEPS = (1000003, 999983, 999979, 999961, 999959, 999953, 999931, 999917)


def sized(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size (words) and more columns."""
    return docs.select(*more, "doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """source, s (its number), source_size, target."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = sources.withColumn("s", F.row_number().over(by) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("s") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    # by cap per weight, those before the first that isn't capped are; the level comes from the rest
    at = Window.orderBy(F.col("cap") / F.col("weight"), "s")
    earlier = at.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("weight").over(at.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("nth", F.row_number().over(at))
    level = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("nth", "level"))).over(every)["level"]
    s = s.withColumn("target", F.least("cap", F.coalesce(level * F.col("weight"), "cap")))
    return s.select("source", F.col("s").cast("int").alias("s"), "source_size", "target")


def stream(sizes: DataFrame, goal: DataFrame, seed: int, buckets: int = BUCKETS) -> DataFrame:
    """sizes with s, source_size, target, bucket, nth (place in the bucket) and start: the document's place in its source's stream of words.

    The stream runs through the source's buckets; bucket sums give each bucket's start and a window within the bucket
    gives the rest, so a source that holds most rows is summed by many tasks.
    """
    d = sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    d = d.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int"))
    sums = d.groupBy("s", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("s", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside))
    return d.join(base, ["s", "bucket"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("h", "upto", "base")


def uniform(*keys: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 12).cast("double") + 0.5) / float(1 << 52)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(good: Column, rest: Column, n: Column, u: Column) -> Column:
    """How many of n balls drawn from good + rest are good, as the inverse of the distribution at u.

    The weights run by their recurrence over 12 standard deviations either side of the mode; beyond is less than 1e-20.
    """
    total = (good + rest).cast("double")
    low, high = F.greatest(F.lit(0), n - rest), F.least(n, good)
    mode = F.floor((n + 1).cast("double") * (good + 1) / (total + 2)).cast("long")
    reach = F.ceil(12 * F.sqrt(n * (good / total) * (rest / total)) + 12).cast("long")
    window = F.sequence(F.least(high, F.greatest(low, mode - reach)), F.greatest(low, F.least(high, mode + reach)))

    def then(w: Column, x: Column) -> Column:
        return w * ((good - x).cast("double") * (n - x)) / ((x + 1).cast("double") * (rest - n + x + 1))

    def draw(xs: Column) -> Column:
        start = [F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("got")]
        whole = F.aggregate(xs, F.struct(*start), lambda t, x: F.struct(then(t["w"], x).alias("w"), (t["sum"] + t["w"]).alias("sum"), t["got"].alias("got")), lambda t: t["sum"])

        def pick(goal: Column) -> Column:
            step = lambda t, x: F.struct(
                then(t["w"], x).alias("w"), (t["sum"] + t["w"]).alias("sum"), F.when((t["got"] < 0) & (t["sum"] + t["w"] >= goal), x).otherwise(t["got"]).alias("got")
            )
            return F.aggregate(xs, F.struct(*start), step, lambda t: F.when(t["got"] < 0, F.element_at(xs, -1)).otherwise(t["got"]))

        return let(whole * u, pick)

    return F.when((n <= 0) | (good <= 0), F.lit(0).cast("long")).when(rest <= 0, n).otherwise(let(window, draw))


def deal(goal: DataFrame, seed: int, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """shard, s, slot, block: every block of every source in its shard, by the splitting tree.

    One row holds each source's number of blocks; each level of the tree makes two rows of one.
    """
    quotas = goal.select("s", F.ceil(F.round("target") / block).cast("long").alias("q"))
    root = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "q"))), lambda x: x["q"]).alias("counts"), F.sum("q").alias("n"))
    levels = max(0, math.ceil(math.log2(max(1, (root.first()["n"] or 0) / shard))))  # one number
    nodes = root.select(F.lit(0).cast("long").alias("node"), "counts", "n")
    for level in range(levels):
        left_n = F.ceil(F.col("n") / 2).cast("long")

        key = [F.lit(seed), F.lit(level), F.col("node")]

        def split(acc: Column, s: Column) -> Column:
            good = F.element_at(F.col("counts"), s + 1)
            x = hypergeometric(good, acc["rest"] - good, acc["need"], uniform(*key, s))  # noqa: B023
            return let(x, lambda x: F.struct((acc["rest"] - good).alias("rest"), (acc["need"] - x).alias("need"), F.concat(acc["left"], F.array(x)).alias("left")))

        start = F.struct(F.col("n").alias("rest"), left_n.alias("need"), F.expr("cast(array() as array<bigint>)").alias("left"))
        nodes = nodes.withColumn("left", F.when(F.size("counts") > 0, F.aggregate(F.sequence(F.lit(0), F.size("counts") - 1), start, split, lambda acc: acc["left"])))
        both = F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("counts"), left_n.alias("n")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("counts", "left", lambda a, b: a - b).alias("counts"), (F.col("n") - left_n).alias("n")),
        )
        nodes = nodes.select(F.explode(both).alias("x")).select("x.*")
        if level % 4 == 3:
            nodes = materialize(nodes, "tree")
    quota = nodes.select(F.col("node").alias("shard"), F.posexplode("counts").alias("s", "q"))
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.withColumn("base", F.coalesce(F.sum("q").over(before), F.lit(0))).withColumn("all", F.sum("q").over(Window.partitionBy("s"))).where("q > 0")
    numbers = quota.select("shard", "s", "all", F.explode(F.expr("sequence(base, base + q - 1)")).alias("number"))
    step = F.filter(F.array(*[F.lit(p) for p in STEPS]), lambda p: F.col("all") % p != 0)[0]
    # a keyed permutation of 0..all-1: its step has no factor in common with all
    block_no = F.pmod(F.col("number") * step + F.pmod(F.xxhash64(F.lit(seed), "s"), F.col("all")), F.col("all"))
    return numbers.select("shard", "s", block_no.alias("block"), F.xxhash64(F.lit(seed), F.lit("slot"), "s", "number").alias("slot"))


def pieces(placed: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """placed with epoch, block, piece_from, piece_to: the words of a document (from 0) that a block of the mix takes; nulls where none does."""
    epochs = F.transform(
        F.sequence(F.lit(0), F.lit(repeats - 1)),
        lambda e: F.struct(e.alias("epoch"), (F.col("start") + e * F.col("source_size")).alias("at"), F.least(F.col("start") + e * F.col("source_size") + F.col("size"), F.round("target").cast("long")).alias("stop")),
    )
    found = F.flatten(
        F.transform(
            F.filter(epochs, lambda x: x["stop"] > x["at"]),
            lambda x: F.transform(
                F.sequence(F.floor(x["at"] / block), F.floor((x["stop"] - 1) / block)),
                lambda b: F.struct(x["epoch"].alias("epoch"), b.alias("block"), (F.greatest(x["at"], b * block) - x["at"]).alias("piece_from"), (F.least(x["stop"], (b + 1) * block) - x["at"]).alias("piece_to")),
            ),
        )
    )
    return placed.withColumn("piece", F.explode_outer(found)).select("*", "piece.*").drop("piece")


def mix(sizes: DataFrame, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix of sizes (source, size and an id): a row for each piece of a document, with shard and slot; documents not taken have one row with nulls."""
    goal = materialize(targets(sizes, weights), "targets")
    return pieces(stream(sizes, goal, seed), block).join(deal(goal, seed, block, shard), ["s", "block"], "left")


def taken(mixed: DataFrame, *more: str) -> DataFrame:
    """A row for each document of a mix: the words taken of it, repeats counted, and how often it is begun."""
    keys = ["s", "bucket", "nth", "doc_id", "source", "size", "source_size", "target", *more]
    words = F.when(F.col("shard").isNotNull(), F.col("piece_to") - F.col("piece_from")).otherwise(0)
    return mixed.groupBy(*keys).agg(F.sum(words).cast("long").alias("taken"))


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    sizes = materialize(sized(docs_table(spark, sf_dir)), "sizes")
    return taken(mix(sizes)).select("doc_id", "size", "source_size", "target", "taken", "source")


#: Copies of a document that one row stands for until its text is there.
COPIES = 1024


def _key() -> Column:
    """key: alike only for rows alike in id, source and text; which of them are null counts too."""
    of = ("doc_id", "source", "text")
    return F.xxhash64(*of, *[F.col(c).isNull() for c in of]).alias("key")


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """docs as the mix takes them, a row for each time a document is begun; the last time its text may be cut at a word. All columns as they were, n_chars that of the text."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key())
    sizes = materialize(sized(docs.select("doc_id", "source", "text", _key()), "key"), "sizes")
    got = taken(mix(sizes, seed), "key").where("taken > 0").select("key", "size", "taken")
    cut = F.expr("explode(transform(sequence(1, cast(ceil(taken / size) as int)), i -> least(size, taken - (i - 1) * size)))")
    # rows alike in key are alike in text: their cuts are counted, not listed, and meet one of them
    cuts = got.select("key", "size", cut.alias("cut")).groupBy("key", "size", "cut").agg(F.count("*").alias("n"))
    cuts = cuts.select("key", "size", "cut", F.expr(f"explode(transform(sequence(0L, (n - 1) div {COPIES}), i -> cast(least({COPIES}L, n - i * {COPIES}) as int)))").alias("n"))
    if not sizes.groupBy("key").count().where("count > 1").isEmpty():
        own = own.dropDuplicates(["key"])
    rows = own.join(cuts, "key").select("row", "size", "cut", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_copy")).drop("_copy")
    part = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})")), F.lit(1), F.col("cut").cast("int")), " ")
    rows = rows.withColumn("row", F.col("row").withField("text", F.when(F.col("cut") == F.col("size"), F.col("row.text")).otherwise(part)))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast(docs.schema["n_chars"].dataType)))
    return rows.select("row.*")
