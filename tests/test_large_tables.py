"""What grows faster than its tables: pixels as rows, patterns made for each term and text, joins of sides, tasks that read a small file whole."""

import numpy as np
from pyspark.sql import functions as F

from veilframe.functions.spans import never_found
from veilframe.operators import images, layout
from veilframe.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_an_image_is_blacked_as_one_row(spark):
    rng = np.random.default_rng(3)
    px = [rng.integers(1, 255, (h, w, 4), dtype=np.uint8) for h, w in ((5, 7), (3, 4), (6, 6))]
    boxes = [(0, -2, -1, 5, 3), (0, 3, 2, 90, 1), (0, 3, 2, 90, 1), (1, 0, 0, 0, 9), (1, None, 0, 2, 2), (None, 0, 0, 9, 9), (2, 9, 9, 3, 3), (2, 5, 5, 1, 1)]
    d = spark.createDataFrame([(i, p.shape[1], p.shape[0], p.tobytes()) for i, p in enumerate(px)] + [(7, 2, 2, None)], "image_id long, width int, height int, raster binary")
    got = {r.image_id: r.raster for r in images.rasters_blacked(d, spark.createDataFrame(boxes, "image_id long, x int, y int, w int, h int")).collect()}
    for i, p in enumerate(px):
        for k, x, y, w, h in boxes:
            if k == i and x is not None and w > 0:
                p[max(y, 0) : max(y + h, 0), max(x, 0) : max(x + w, 0)] = (0, 0, 0, 255)
        assert bytes(got[i]) == p.tobytes()
    assert got[7] is None


def test_pixels_are_not_shuffled_as_rows(spark):
    assert "Generate" not in plan(QUERIES["pixel_redact_check"](spark, SF))


def test_never_terms_are_found_without_a_pattern_each(spark):
    terms = ["Kelvin risk", "b1@ex.com", "a+b", "aa", "Straße", "ÉTÉ"]
    texts = ["KELVİN RıſK, b1@EX.com", "A+B aa AAA été STRASSE straße", "akelvin risk", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = d.select("i", F.explode(never_found(F.col("t"), terms)).alias("x")).select("i", "x.start", "x.end").collect()
    assert sorted(map(tuple, got)) == [(0, 0, 11), (0, 13, 22), (1, 0, 3), (1, 4, 6), (1, 11, 14), (1, 23, 29)]
    assert "term 0|term 1" not in plan(d.select(F.size(never_found(F.col("t"), [f"term {i}" for i in range(500)]))))


def test_sides_are_told_apart_without_joins(spark):
    a, b = (spark.createDataFrame(x, "image_id int, key string") for x in ([(1, "p"), (1, "p"), (1, "q"), (None, "r")], [(1, "q"), (2, "p"), (None, "r")]))
    out = layout.toggled(a, b)
    assert sorted(map(tuple, out.collect())) == [(1, "p"), (2, "p")]
    assert "Join" not in plan(out)


def test_work_on_a_small_file_is_spread(spark):
    assert QUERIES["never_terms"](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_restoring_and_tagging_start_from_spread_rows(spark, monkeypatch):
    from veilframe.plans import parts, queries

    seen = []
    for module in (parts, queries):
        monkeypatch.setattr(module, "spread", lambda df, real=module.spread: seen.append(df) or real(df))
    for name in ("protect_names", "protect_awkward", "ner_model", "restore_unknown"):
        QUERIES[name](spark, SF)
    assert len(seen) == 4
