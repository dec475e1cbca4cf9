"""A session's life over a table of events: expiry, clearing, status and lists.

Events (session, ts, seq, original, kind, type) are touches of originals or clearings of the whole session. An entry
lives while less than the idle time has passed since its last touch; touched later, or after a clearing, the original
begins a new epoch and gets a new number. Counters run on through expiries and clearings, so no alias is used twice.
Events of other types, such as restores, make nothing here; fold.settled() lets them renew what lives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.patterns import IDLE_SECONDS, KIND_NAMES
from .aliases import first_seen, numbered, token
from .ordered import running


def _with_last_clear(events: DataFrame) -> DataFrame:
    """events with cleared: the last clearing of the session up to the event, itself included."""
    clear = F.col("type") == "clear"
    return running(events, ["session"], [F.col("ts"), ~clear], last={"cleared": F.when(clear, F.col("ts"))})


def epochs(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Touches with epoch: 1 for an original's first life, 2 for the next. A gap of the idle time or more ends a life, and so does a clearing between."""
    touches = _with_last_clear(events).where("type = 'touch'")
    own = Window.partitionBy("session", "original").orderBy("ts", "seq")
    last = F.lag("ts").over(own)
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last.cast("timestamp"))
    touches = touches.withColumn("_last", last).withColumn("_gap", gap)
    fresh = F.col("_last").isNull() | (F.col("_gap") >= idle_seconds * 1_000_000) | F.coalesce(F.col("cleared") > F.col("_last"), F.lit(False))
    return touches.withColumn("epoch", F.sum(fresh.cast("int")).over(own)).drop("_last", "_gap", "cleared")


def lives(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """session, original, epoch, token, kind, created, last_touch and touches of every entry that ever lived."""
    return _lives(epochs(events, idle_seconds))


def _lives(e: DataFrame) -> DataFrame:
    """lives() of touches with their epochs."""
    spans = e.groupBy("session", "original", "epoch").agg(F.min("ts").alias("created"), F.max("ts").alias("last_touch"), F.count("*").alias("touches"))
    firsts = numbered(first_seen(e.withColumn("ord", F.lit(0)).withColumn("tie", F.lit("")), "epoch"))
    return spans.join(firsts.select("session", "original", "epoch", "kind", "seq", token(F.col("kind"), F.col("n")).alias("token")), ["session", "original", "epoch"])


def touched(events: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """session, original, token, ts and seq of every touch, with the alias that it made or renewed."""
    e = epochs(events, idle_seconds)
    names = _lives(e).select("session", "original", "epoch", "token")
    return e.select("session", "original", "epoch", "ts", "seq").join(names, ["session", "original", "epoch"]).select("session", "original", "token", "ts", "seq")


def live_at(entries: DataFrame, clears: DataFrame, now, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """Entries alive at now, a timestamp: those touched since, and not cleared after. listed() orders them."""
    now = F.lit(now).cast("timestamp_ntz")
    last_clear = clears.where(F.col("ts") <= now).groupBy("session").agg(F.max("ts").alias("_cleared"))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_touch").cast("timestamp"))
    e = entries.where((F.col("created") <= now) & (age >= 0) & (age < idle_seconds * 1_000_000)).join(last_clear, "session", "left")
    return e.where(F.col("_cleared").isNull() | (F.col("last_touch") > F.col("_cleared"))).withColumn("age_s", F.floor(age / 1_000_000)).drop("_cleared")


def listed(live: DataFrame) -> DataFrame:
    """session, token, original and kind of live entries in the order in which they were made."""
    return live.orderBy("session", F.col("seq").asc_nulls_last(), "token").select("session", "token", "original", "kind")


def status(live: DataFrame, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """session, count and expires_in_seconds, the whole seconds until the first entry expires."""
    return live.groupBy("session").agg(F.count("*").alias("count"), F.min(F.lit(idle_seconds) - F.col("age_s")).cast("long").alias("expires_in_seconds"))


def kind_name(kind):
    """A kind as it is shown; itself where it has no name."""
    names = F.create_map(*[F.lit(x) for pair in KIND_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, kind), kind)


def search(mappings: DataFrame, query: str, most: int = 50) -> DataFrame:
    """The first mappings, in the order in which they were made, whose token, kind, shown kind or original holds the query, whatever its case."""
    line = F.lower(F.concat_ws(" ", "token", "kind", kind_name(F.col("kind")), "original"))
    return mappings.where(line.contains(query.lower())).orderBy("session", "seq", "ord").limit(most)


#: Letters of a gram, and parts of the index: of grams by their hashes, of rows by their places.
GRAM, PARTS, BLOCK = 3, 64, 1 << 16
KEY = ["session", "seq", "ord", "token"]


def _line() -> Column:
    return F.lower(F.concat_ws(" ", "token", "kind", kind_name(F.col("kind")), "original"))


def write_search_index(mappings: DataFrame, path: str) -> None:
    """An index for search_pages() at path: mappings (session, seq, ord, token, kind, original) in blocks, and which rows hold each run of three characters, in parts by its hash."""
    spark = mappings.sparkSession
    m = mappings.select(*KEY, "kind", "original", F.xxhash64(*KEY).alias("id"))
    m.withColumn("block", F.pmod("id", F.greatest(F.lit(1), F.lit(-(-mappings.count() // BLOCK)))).cast("int")).repartition("block").write.mode("overwrite").partitionBy("block").parquet(f"{path}/rows")
    line = spark.read.parquet(f"{path}/rows").select("id", "block", _line().alias("line"))
    at = F.sequence(F.lit(1), F.length("line") - (GRAM - 1))
    grams = F.array_distinct(F.transform(at, lambda i: F.substring(F.col("line"), i, F.lit(GRAM))))
    grams = line.where(F.length("line") >= GRAM).select(F.explode(grams).alias("gram"), "id", "block").withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)).cast("int"))
    # a gram that many rows hold is dealt to several tasks; within one, rows of a gram lie together, so a scan skips the others
    grams.repartition("part", F.pmod("id", F.lit(8))).sortWithinPartitions("part", "gram").write.mode("overwrite").partitionBy("part").parquet(f"{path}/grams")


def search_pages(spark: SparkSession, path: str, query: str, after: tuple | None = None, page: int = 50) -> DataFrame:
    """The next page of mappings whose token, kind, shown kind or original holds the query, whatever its case, in the order of (session, seq, ord, token), after the row of that key, None for the first.

    Only the parts of the query's grams are read, and of the rows only blocks that hold all of these; a query shorter
    than a gram reads all rows. Nulls in the key come first, as Spark sorts them.
    """
    q = query.lower()
    rows = spark.read.parquet(f"{path}/rows")
    if len(q) >= GRAM:
        grams = sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})
        parts = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.pmod(F.xxhash64("g"), F.lit(PARTS)).cast("int")).distinct().collect()]
        found = spark.read.parquet(f"{path}/grams").where(F.col("part").isin(parts) & F.col("gram").isin(grams))
        every = found.groupBy("id", "block").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("id", "block")
        rows = rows.join(every, ["block", "id"], "left_semi")
    rows = rows.where(_line().contains(q))
    if after is not None:
        rows = rows.where(F.struct(*KEY) > F.struct(*[F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in zip(KEY, after, strict=True)]))
    return rows.orderBy(*KEY).limit(page).select(*KEY, "kind", "original")
