"""The stateful stream gives what the batch gives, and keeps its counters."""

import time

from veilframe.streaming.protecting import protect_stream


def finish(spark, q, name, rows):
    """In processing time a query goes on with batches without data, so it is stopped once all rows are there."""
    end = time.time() + 120
    while time.time() < end and q.isActive and spark.table(name).count() < rows:
        time.sleep(0.5)
    q.stop()
    assert q.exception() is None


def test_stream_of_texts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session string, seq long, text string"
    for k, texts in enumerate([[("s", 1, "a@b.co x@y.zz"), ("s", 2, "EMAIL_1 no")], [("s", 3, "x@y.zz new@q.io"), ("t", 4, "a@b.co")]]):
        spark.createDataFrame(texts, schema).coalesce(1).write.json(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    q = protect_stream(source).writeStream.format("memory").queryName("shown").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    finish(spark, q, "shown", 4)
    got = {r["seq"]: (r["text"], r["status"]) for r in spark.table("shown").collect()}
    first = {1: ("EMAIL_1 EMAIL_2", "ok"), 2: (None, "collision"), 4: ("EMAIL_1", "ok")}
    assert {k: got[k] for k in first} == first
    assert got[3][0] == "EMAIL_2 EMAIL_3"


def test_stream_of_calls(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "session string, seq long, text string, op string"
    calls = [("s", 1, "a@b.co x@y.zz", "protect"), ("s", 2, "see email_2, PERSON_1 and EMAIL_1's", "restore"), ("s", 3, None, "clear"), ("s", 4, "EMAIL_1", "restore"), ("s", 5, "x@y.zz", None)]
    spark.createDataFrame(calls, schema).coalesce(1).write.json(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    q = protect_stream(source).writeStream.format("memory").queryName("calls").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    finish(spark, q, "calls", 5)
    got = {r["seq"]: (r["text"], r["count"]) for r in spark.table("calls").collect()}
    assert got == {1: ("EMAIL_1 EMAIL_2", 2), 2: ("see x@y.zz, PERSON_1 and a@b.co's", 2), 3: (None, 0), 4: ("EMAIL_1", 0), 5: ("EMAIL_3", 1)}
