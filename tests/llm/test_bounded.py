"""What grows with the data in no task and not on the driver: hot words, copies of one row, blocks of a benchmark."""

import random
from collections import Counter, defaultdict

import numpy as np
from pyspark import Broadcast
from pyspark.sql import functions as F

from veilframe.llm import classlm, decontam, jaccard, mixing

from .helpers import documents, prose


def test_a_hot_word_has_a_row_for_each_class_beside_it(spark):
    rng = random.Random(1)
    d = documents(spark, [" ".join(rng.choice(["the", "the", *"abcdefghij"]) + rng.choice(["", "x"]) for _ in range(40)) for _ in range(300)]).repartition(13)
    train = d.select(F.col("text").cast("binary").alias("text"))
    items = classlm.Items(np.empty(0, dtype=np.uint64))
    classes = np.arange(items.size) % classlm.CLASSES
    every = classlm.Tokens([r.text.encode() for r in d.collect()])
    got = {}
    for name, hot in (("hot", every.hashes), ("rare", every.hashes[:0]), ("some", every.hashes[::2])):
        sums, count = defaultdict(Counter), Counter()
        for r in classlm.neighbours(train, items, classes, hot).collect():
            count[r.h] += 1
            for x in r.near:
                sums[r.h, r.seed][x >> classlm.COUNT] += x & ((1 << classlm.COUNT) - 1)
        got[name] = sums
        if name == "hot":
            assert max(count.values()) <= 2 * classlm.CLASSES
            assert all(len(k) == count[h] for (h, _), k in sums.items())  # one row for each class: sums are whole
        table = np.ones((classlm.CLASSES, classlm.CLASSES)) * 50
        got[name + " placed"] = {(r.h, r.cls) for r in classlm.placed(classlm.neighbours(train, items, classes, hot), table, 3).collect()}
    assert got["hot"] == got["rare"] == got["some"]
    assert got["hot placed"] == got["rare placed"] == got["some placed"]
    assert sum(sum(v.values()) for v in got["hot"].values()) == 2 * 300 * 40


def test_copies_of_one_row_are_one_text_in_the_proof(spark):
    rng = random.Random(2)
    a = prose(rng, 60)
    b = a + " and a few more"
    hot = spark.range(10_000, numPartitions=8).select(F.lit(1).cast("long").alias("doc_id"), F.lit(a).alias("text"))
    d = hot.union(spark.createDataFrame([(2, b), (None, a), (None, a)], "doc_id long, text string"))
    assert jaccard.texts(d).count() == 3
    got = jaccard.jaccard_join(d).groupBy("class_id", "component_id", "n_links").count().collect()
    assert {(r["class_id"], r["component_id"], r["n_links"], r["count"]) for r in got} == {(1, 1, 10_002, 10_002), (2, 1, 10_002, 1)}
    assert [r.text for r in jaccard.keep_first(d).collect()] == [a]


def test_one_block_of_a_benchmark_lives_at_a_time(spark, monkeypatch):
    rng = random.Random(3)
    items = [prose(rng, 20) for _ in range(60)]
    texts = [prose(rng, 30) + " " + items[i % 60] + " " + prose(rng, 30) for i in range(90)] + [None, ""]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    alive, most, made = set(), [0], []
    search, destroy = decontam._search, Broadcast.destroy

    def counting(*args):
        out, shared = search(*args)
        alive.add(id(shared))
        made.append(shared)
        most[0] = max(most[0], len(alive))
        return out, shared

    def gone(self, *args):
        alive.discard(id(self))
        return destroy(self, *args)

    d = documents(spark, texts)
    key = lambda r: (r.doc_id, r.n_words, sorted((s.start, s.stop) for s in r.spans), sorted(r["items"]))
    whole = sorted(key(r) for r in decontam.hit_spans(d, bench, "doc_id").collect())
    monkeypatch.setattr(decontam, "_search", counting)
    monkeypatch.setattr(Broadcast, "destroy", gone)
    size = sum(len(t) for t in items)
    blocks = sorted(key(r) for r in decontam.hit_spans(d, bench, "doc_id", block_bytes=-(-size // 20)).collect())
    assert blocks == whole
    assert (len(made), most[0], len(alive)) == (20, 1, 0)


def test_copies_of_one_row_are_counted_by_the_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 7)
    hot = spark.range(3000, numPartitions=5).select(F.lit(1).cast("long").alias("doc_id"), F.lit("web").alias("source"), F.lit("a few words here").alias("text"), F.lit(16).alias("n_chars"))
    nulls = spark.createDataFrame([(5, None, "web", 3), (5, "web", None, 0), (None, "web", "one two", 7)], "doc_id long, source string, text string, n_chars int")
    d = hot.union(nulls)
    want = mixing.taken(mixing.mix(mixing.sized(d))).agg(F.sum("taken")).first()[0]
    got = mixing.mixed_documents(d).collect()
    assert sum(len(r.text.split()) for r in got) == want > 10_000
    assert {r.doc_id for r in got} >= {1}
    keys = d.select(mixing._key()).distinct().count()
    assert keys == 4
