"""Term lists as tables against the same terms as rules, never-terms by sweep against each met with each, boxes by sweep."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.spans import all_spans, never_found, resolved, terms_found
from veilframe.operators import terms
from veilframe.operators.images import pixels_blacked
from veilframe.plans import lists as list_queries

TERMS = ["Acme", "acme corp", "corp", "Acme Corp Ltd", "a.b", "$x", "+++", "é l'an", "STRASSE", "x|y", "two  spaces", "a@b.io", "b.io"]
PIECES = ["acme", "ACME", "corp", "Ltd", "a.b", "$x", "+++", "É L'AN", "strasse", "x|y", "two  spaces", "a@b.io", "c@d.io", ",", "(", "9", "ü"]


def texts(seed, n=120):
    rng = random.Random(seed)
    return [" ".join(rng.choice(PIECES) for _ in range(rng.randrange(12))) for _ in range(n)] + [None, ""]


def table(spark, seed):
    rows = [(i, "ab"[i % 2], t) for i, t in enumerate(texts(seed))] + [(900, None, "acme"), (901, "none", "acme")]
    return spark.createDataFrame(rows, "_row long, list_id string, text string")


def lists(spark):
    rows = [("a", t) for t in TERMS] + [("b", t) for t in TERMS[::2]] + [("a", TERMS[0]), (None, "acme"), ("a", None), ("a", "")]
    return spark.createDataFrame(rows, "list_id string, term string")


@pytest.mark.parametrize("seed", range(2))
def test_lists_find_what_rules_find(spark, seed):
    d = table(spark, seed)
    got = {r._row: [(s.start, s.end, s.kind) for s in r.found] for r in terms.always_spans(d, lists(spark), "_row").collect()}
    assert got[900] == got[901] == []
    n = 0
    for name, own in (("a", TERMS), ("b", TERMS[::2])):
        for r in d.where(f"list_id = '{name}' AND _row < 900").select("_row", terms_found(F.col("text"), own).alias("s")).collect():
            want = [(s.start, s.end, s.kind) for s in r.s or []]
            assert got[r._row] == want
            n += len(want)
    assert n > 300


@pytest.mark.parametrize("rows", [100_000, 25])
def test_never_terms_of_tables_suppress_what_rules_suppress(spark, rows):
    d = table(spark, 7).where("list_id = 'a'")
    found = d.select("_row", F.explode(all_spans(F.col("text"))).alias("s")).select("_row", "s.*")
    left = terms.unsuppressed(found, terms.never_ranges(d, lists(spark), "_row"), ["_row"], rows=rows)
    got = left.groupBy("_row").agg(F.collect_list(F.struct("start", "end", "kind", "priority", "det", "seq")).alias("s")).select("_row", resolved(F.col("s")).alias("s"))
    got = {r._row: [(s.start, s.end, s.kind) for s in r.s] for r in got.collect()}
    rule = d.select("_row", resolved(all_spans(F.col("text")), never_found(F.col("text"), TERMS)).alias("s"))
    want = {r._row: [(s.start, s.end, s.kind) for s in r.s] for r in rule.collect() if r.s}
    assert got == want
    assert 0 < sum(map(len, want.values())) < found.count()


def test_suppression_is_of_spans_wholly_inside(spark):
    spans = spark.createDataFrame([(1, 0, 5, "a"), (1, 2, 9, "b"), (1, 3, 4, "c"), (2, 0, 5, "d"), (None, 1, 2, "e")], "k long, start int, end int, n string")
    ranges = spark.createDataFrame([(1, 0, 6), (1, 1, 3), (2, 1, 9), (None, 0, 9)], "k long, start int, end int")
    assert sorted(r.n for r in terms.unsuppressed(spans, ranges, ["k"]).collect()) == ["b", "d"]
    assert terms.unsuppressed(spans, ranges.limit(0), ["k"]).count() == 5
    assert terms.unsuppressed(spans.limit(0), ranges, ["k"]).count() == 0


def test_boxes_by_sweep(spark):
    rng = random.Random(5)
    sizes = {1: (9, 7), 2: (3, 3), None: (2, 2)}
    pixels = [(i, x, y, 1, 2, 3, 4) for i, (w, h) in sizes.items() for x in range(w) for y in range(h)]
    boxes = [(1, rng.randrange(-3, 10), rng.randrange(-3, 8), rng.randrange(-1, 4), rng.randrange(-1, 4)) for _ in range(9)] + [(1, 1, 1, 2, 2)] * 2 + [(None, 0, 0, 9, 9), (5, 0, 0, 1, 1), (2, -9, -9, 10, 99), (2, None, 0, 1, 1)]
    p = spark.createDataFrame(pixels, "image_id int, x int, y int, r int, g int, b int, a int").repartition(3)
    got = {tuple(r)[:3]: tuple(r)[3:] for r in pixels_blacked(p, spark.createDataFrame(boxes, "image_id int, x int, y int, w int, h int")).collect()}
    assert len(got) == len(pixels)
    for i, x, y, *_ in pixels:
        inside = i is not None and any(b[0] == i and None not in b and b[1] <= x < b[1] + b[3] and b[2] <= y < b[2] + b[4] for b in boxes)
        assert got[i, x, y] == ((0, 0, 0, 255) if inside else (1, 2, 3, 4))


def test_a_text_is_searched_once_whatever_is_asked_of_its_finds(spark):
    q = list_queries.det_term_lists(spark, "/root/testdata/sf0.001")
    p = q._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("aggregate(split(regexp_replace(") == 1


def test_the_plain_search_keeps_every_term_that_a_pattern_finds(spark):
    own = ["Kelvin risk", "b1@ex.com", "a+b", "aa", "stra", "i", "Straße", "ÉTÉ", "x\\y", "longer than any"]
    some = ["KELVİN RıſK", "kelvin RISK", "B1@EX.COM", "A+B", "STRAẞE", "straße été", "İ", "ı", "X\\Y", "\u212aelvin ri\u017fk", "ﬁ", "İİaA", "", None]
    d = spark.createDataFrame([(t,) for t in some], "t string").withColumn("terms", F.array(*[F.lit(t) for t in own]))
    found = F.filter("terms", lambda t: F.rlike(F.col("t"), F.concat(F.lit("(?iu)"), terms.quoted(t))))
    seen = 0
    for r in d.select("t", terms.held(F.col("t"), F.col("terms")).alias("held"), found.alias("found")).collect():
        if r.t is not None:
            assert set(r.found) <= set(r.held) and not {"longer than any"} & set(r.held)
            seen += len(r.found)
    assert seen > 12


def test_terms_without_words_are_looked_for_in_every_text(spark):
    d = spark.createDataFrame([(1, "a", "x +++ y"), (2, "a", "+++"), (3, "b", "+++"), (4, "a", None), (5, "a", "")], "_row long, list_id string, text string")
    t = spark.createDataFrame([("a", "+++"), ("b", "word")], "list_id string, term string")
    got = {r._row: [(s.start, s.end) for s in r.found] for r in terms.always_spans(d, t, "_row").collect()}
    assert got == {1: [(2, 5)], 2: [(0, 3)], 3: [], 4: [], 5: []}
