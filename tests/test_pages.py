"""Screenshots, each in one row, against protecting by sessions and boxes by joins."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.operators import layout, screenshots
from veilframe.operators.protect import protect, protect_each
from veilframe.operators.rules import Rules
from veilframe.plans import parts  # noqa: F401  registers its queries
from veilframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
PIECES = ["a@b.io", "A@b.io", "c@d.io", "10.0.0.8", "415-555-0132", "word", "acme", "x_1", "", None, "é", "a@b.ioa@b.io", "m", "https://a@b.io/c"]
RULES = Rules.checked(["acme", "a@b.io"], ["c@d.io"])


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def words(spark, seed, images=40, most=30, long=400):
    rng = random.Random(seed)
    rows = []
    for i in [*range(images), None]:
        kept = PIECES if rng.random() < 0.3 else [p for p in PIECES if p != "x_1"]
        for k in range(long if i == 3 else rng.randrange(1, most)):
            rows.append((i, k, rng.choice(kept), rng.choice([10, 20, 20, 300]), rng.randrange(30), rng.choice([0, 10, 40, None]), 10, 0.9))
    return spark.createDataFrame(rows, "image_id long, word_ix int, text string, x int, y int, w int, h int, conf float")


def texts(spark):
    rng = random.Random(4)
    made = [" ".join(rng.choice([p or "-" for p in PIECES]) for _ in range(rng.randrange(40))) for _ in range(150)]
    return spark.createDataFrame([(i, t) for i, t in enumerate([*made, None, "", "a@b.io " * 20_000])], "doc_id long, text string")


@pytest.mark.parametrize("rules", [Rules(), RULES])
def test_rows_of_their_own_are_protected_as_sessions_of_one(spark, rules):
    d = texts(spark).withColumn("status", F.lit("theirs"))
    want = protect(d, rules, session="doc_id")[0]
    got = protect_each(d, rules)
    assert got.dtypes == want.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Join" not in plan(got) and "RepartitionByExpression" not in plan(got)


@pytest.mark.parametrize("chunk", [layout.CHUNK, 3])
def test_boxes_of_a_page_are_those_of_joins(spark, monkeypatch, chunk):
    monkeypatch.setattr(layout, "CHUNK", chunk)
    w = layout.joined(words(spark, 1))
    pages = layout.paged(w)
    assert sorted(map(repr, pages.select("image_id", "text").collect())) == sorted(map(repr, layout.image_text(w).collect()))
    pairs = [(i, f"T{k}", p) for i in range(40) for k, p in enumerate(p for p in PIECES if p)]
    m = spark.createDataFrame(pairs, "image_id long, token string, original string")
    want = {(r.image_id, r.token): r.boxes for r in layout.boxes(w, m).collect()}
    listed = m.groupBy("image_id").agg(F.collect_list(F.struct("token", "original")).alias("mappings"))
    got = pages.join(listed, "image_id").select("image_id", F.explode(layout.boxes_within(F.col("text"), F.col("words"), F.col("mappings"))).alias("r")).select("image_id", "r.*")
    got = {(r.image_id, r.token): r.boxes for r in got.collect()}
    assert got == want and len(want) > 100


def test_words_are_gathered_once_and_not_joined(spark):
    p = plan(QUERIES["ocr_detect"](spark, SF))
    assert "Join" not in p and p.count("Aggregate") == 1 and p.count("Relation") == 1


def test_images_without_aliases_and_without_a_name_give_a_row(spark):
    d = spark.createDataFrame([(1, 0, "plain", 0, 0, 9, 9, 0.9), (2, 0, "EMAIL_1", 0, 0, 9, 9, 0.9), (None, 0, "a@b.io", 0, 0, 9, 9, 0.9)], "image_id long, word_ix int, text string, x int, y int, w int, h int, conf float")
    got = {r.image_id: r for r in screenshots.detected_words(d).collect()}
    assert (got[1]["count"], got[1].redactions, got[2].status, got[2]["count"], got[2].redactions) == (0, [], "collision", None, [])
    assert got[None].text == "EMAIL_1" and [(r.token, len(r.boxes)) for r in got[None].redactions] == [("EMAIL_1", 1)]
