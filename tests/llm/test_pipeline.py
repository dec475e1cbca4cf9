"""The pipeline's stages on awkward tables and against each other."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from veilframe.llm.common import materialize

from .helpers import SCHEMA, awkward, documents, empty, prose


def _dir(spark, tmp_path, docs, items):
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(20)
    item = prose(rng, 20)
    texts = [prose(rng, 80) for _ in range(60)]
    texts += [texts[0], texts[1] + " x", f"{item} tail", "123 456", None]
    sf = _dir(spark, tmp_path, documents(spark, texts), [(1, item)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == [c.split()[0].strip("`") for c in SCHEMA.split(", ")]
        left[name] = {r[0] for r in docs.select("doc_id").collect()}
    assert left["language_id"] == set(range(63))
    assert left["ngram_jaccard_join"] == set(range(60)) | {62}
    assert left["benchmark_decontamination"] == set(range(60))
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == docs.count()
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    total, last = out.agg(F.sum("n_tokens"), F.max(F.col("start") + F.col("n_tokens"))).first()
    assert total == last


def test_stages_bear_awkward_and_empty_tables(spark, tmp_path):
    for k, docs in enumerate((awkward(spark), empty(spark))):
        sf = _dir(spark, tmp_path / str(k), docs, [(1, "a b c"), (None, None)])
        for name, stage in corpus_pipeline.STAGES:
            got = materialize(stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf), name)
            assert got.count() >= 0


def test_stages_match_brute_force(spark, tmp_path):
    from array import array
    from collections import Counter
    from zlib import crc32

    from tokenizers import Tokenizer

    from veilframe.llm import langid, tokens

    from .test_operators import hits, jaccard_brute

    rng = random.Random(21)
    items = [(1, prose(rng, 30)), (2, "short item")]
    base = [prose(rng, 70) for _ in range(30)]
    texts = base + [f"{t} z{i}" for i, t in enumerate(base[:9])] + base[:5] + [f"{items[0][1]} {prose(rng, 40)}", f"{prose(rng, 10)} short item", "12 34", "", None, base[3] + " tail one"]
    sf = _dir(spark, tmp_path, documents(spark, texts), items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(langid.learnable(docs))
    left = [i for i, t in enumerate(texts) if model.predict(t)[0] != langid.UNKNOWN and model.predict(t)[1] >= 0.003]
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    docs = materialize(stages["language_id"](spark, docs, sf), "a")
    assert ids(docs) == left
    root = jaccard_brute([texts[i] for i in left])[1]
    left = [left[k] for k, r in enumerate(root) if r == k]
    docs = materialize(stages["ngram_jaccard_join"](spark, docs, sf), "b")
    assert ids(docs) == left
    left = [i for i in left if not (h := hits(texts[i], items))[1] or 20 * h[1] < h[0]]
    docs = materialize(stages["benchmark_decontamination"](spark, docs, sf), "c")
    assert ids(docs) == left
    docs = materialize(stages["source_mixing"](spark, docs, sf), "d")
    mixed = docs.select("doc_id", "text").collect()
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 3 and all(texts[r["doc_id"]].startswith(r["text"]) for r in mixed)
    whole = sum(len(texts[i].split()) for i in left)
    assert abs(sum(len(r["text"].split()) for r in mixed) - whole) <= 3
    plain = Tokenizer.from_file(tokens.default_tokenizer())
    got = stages["token_files"](spark, docs, sf).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(r["doc_id"] for r in mixed)
    want = Counter((r["doc_id"], crc32(array("I", plain.encode(r["text"], add_special_tokens=False).ids + [0]).tobytes())) for r in mixed)
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
