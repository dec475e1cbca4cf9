"""Recognised words to text, and finds in that text to pixel boxes.

Words are rows (image_id, word_ix, text, x, y, w, h, conf). Joined words add start and end in the image's text, in code
points, and the separator before the word: none where it continues the word before on the same line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import MAX_BYTES
from ..functions.text import let

MOST_WORDS, MOST_RESPONSE_BYTES = 10_000, 4 * 1024 * 1024


def joined(words: DataFrame) -> DataFrame:
    """words with sep, start and end."""
    w = Window.partitionBy("image_id").orderBy("word_ix")
    before = {c: F.lag(c).over(w) for c in ("x", "y", "w", "h")}
    d = words.select("*", *[v.alias(f"_{c}") for c, v in before.items()])
    line = (F.col("_y") < F.col("y") + F.col("h")) & (F.col("y") < F.col("_y") + F.col("_h"))
    gap = F.col("x").cast("long") - (F.col("_x") + F.col("_w"))
    most = F.greatest(F.floor(F.least("_h", "h") / 8), F.lit(1))
    sep = F.when(F.col("_x").isNull() | (line & (gap <= most)), "").otherwise(" ")
    d = d.withColumn("sep", sep).drop("_x", "_y", "_w", "_h")
    end = F.sum(F.length("sep") + F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    return d.withColumn("end", end).withColumn("start", F.col("end") - F.length("text"))


def image_text(words: DataFrame) -> DataFrame:
    """image_id and text of joined words."""
    piece = F.struct("word_ix", F.concat("sep", "text").alias("t"))
    return words.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["t"]), "").alias("text"))


def paged(words: DataFrame) -> DataFrame:
    """image_id, text and words of joined words: those words that have a box (start, end, box: padded), in order. One reading of an image gives all that is looked up in it."""
    box = F.when((F.col("w") > 0) & (F.col("h") > 0), padded(*[F.col(c) for c in "xywh"]))
    piece = F.struct("word_ix", F.concat("sep", "text").alias("t"), "start", "end", box.alias("box"))
    d = words.groupBy("image_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    boxed = F.filter("p", lambda x: x["box"].isNotNull() & x["start"].isNotNull())
    return d.select("image_id", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("text"), F.transform(boxed, lambda x: F.struct(x["start"], x["end"], x["box"])).alias("words"))


def padded(x: Column, y: Column, w: Column, h: Column) -> Column:
    """A box grown by a tenth of its height, two pixels at least; its origin stops at 0."""
    pad = F.greatest(F.floor(h / 10).cast("int"), F.lit(2))
    box = {"x": F.greatest(x - pad, F.lit(0)), "y": F.greatest(y - pad, F.lit(0)), "w": w + pad * 2, "h": h + pad * 2}
    return F.struct(*[v.cast("int").alias(k) for k, v in box.items()])


def occurrences(text: Column, needle: Column) -> Column:
    """start and end of a literal in a text, without overlaps."""
    def step(acc: Column, gap: Column) -> Column:
        start = (acc["pos"] + F.length(gap)).cast("int")
        return F.struct((start + F.length(needle)).cast("int").alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + F.length(needle)).cast("int").alias("end")))).alias("out"))

    gaps = F.split(text, F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(-1))
    start = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<struct<start: int, end: int>>)").alias("out"))
    return F.when(F.length(needle) > 0, let(gaps, lambda g: F.aggregate(F.slice(g, F.lit(1), F.greatest(F.size(g) - 1, F.lit(0))), start, step, lambda acc: acc["out"])))


def boxes(words: DataFrame, mappings: DataFrame) -> DataFrame:
    """image_id, token and boxes: the padded boxes of the words that an occurrence of a mapping's original overlaps.

    words: joined. mappings: image_id, token, original. Every mapping that occurs in an image's text counts, not only
    those made by the call. Equal boxes once, in the order first seen; mappings without boxes are left out.
    """
    found = image_text(words).join(mappings, "image_id").select("image_id", "token", F.posexplode(occurrences(F.col("text"), F.col("original"))).alias("occ", "o"))
    w = words.where("w > 0 and h > 0").select("image_id", "word_ix", "start", "end", padded(*[F.col(c) for c in "xywh"]).alias("box"))
    hit = found.join(w, "image_id").where((F.col("start") < F.col("o.end")) & (F.col("end") > F.col("o.start")))
    first = hit.groupBy("image_id", "token", "box").agg(F.min(F.struct("occ", "word_ix")).alias("at"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "box"))), lambda x: x["box"])
    return first.groupBy("image_id", "token").agg(ordered.alias("boxes"))


#: Words of a page that are passed over at once where an occurrence lies elsewhere.
CHUNK = 64


def boxes_within(text: Column, words: Column, mappings: Column) -> Column:
    """boxes() of one image's mappings (token, original), from its text and words as paged() gives them: token and boxes, by token."""
    meets = lambda x, o: (x["start"] < o["end"]) & (x["end"] > o["start"])
    chunk = lambda i: F.slice(words, i + 1, F.lit(CHUNK))
    bounds = lambda c: F.struct(F.array_min(F.transform(c, lambda w: w["start"])).alias("start"), F.array_max(F.transform(c, lambda w: w["end"])).alias("end"), c.alias("words"))
    # few words are looked at without chunks
    chunks = F.when(F.size(words) > CHUNK, F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(CHUNK)), lambda i: let(chunk(i), bounds)))

    def first_seen(hits: Column) -> Column:
        by_box = F.sort_array(F.transform(hits, lambda b, i: F.struct(b.alias("box"), i.alias("at"))))
        once = let(by_box, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["box"] != x["box"])))
        first = F.transform(F.sort_array(F.transform(once, lambda x: F.struct(x["at"].alias("at"), x["box"].alias("box")))), lambda x: x["box"])
        return F.when(F.size(hits) > 1, first).otherwise(hits)

    def of(cs: Column) -> Column:
        def hit(o: Column) -> Column:
            near = F.coalesce(F.flatten(F.transform(F.filter(cs, lambda c: meets(c, o)), lambda c: c["words"])), words)
            return F.transform(F.filter(near, lambda w: meets(w, o)), lambda w: w["box"])

        found = F.transform(mappings, lambda m: F.struct(m["token"].alias("token"), let(F.flatten(F.transform(occurrences(text, m["original"]), hit)), first_seen).alias("boxes")))
        return F.sort_array(F.filter(found, lambda r: F.size(r["boxes"]) > 0))

    return F.when(F.size(mappings) > 0, let(chunks, of))


def clamped(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """A drawn box in whole pixels inside the image; null if it isn't finite and positive or has less than two pixels a side."""
    sound = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")) for c in (x, y, w, h)]
    left, top = F.greatest(F.floor(x), F.lit(0)), F.greatest(F.floor(y), F.lit(0))
    right, bottom = F.least(F.ceil(x + w), width), F.least(F.ceil(y + h), height)
    ok = sound[0] & sound[1] & sound[2] & sound[3]
    box = F.struct(left.cast("int").alias("x"), top.cast("int").alias("y"), (right - left).cast("int").alias("w"), (bottom - top).cast("int").alias("h"))
    return F.when(ok, F.when((w > 0) & (h > 0) & (right - left >= 2) & (bottom - top >= 2), box))


def flattened(redactions: DataFrame) -> DataFrame:
    """image_id, token, box and key "x,y,w,h" of each box."""
    e = redactions.select("image_id", "token", F.explode("boxes").alias("box"))
    return e.withColumn("key", F.concat_ws(",", "box.x", "box.y", "box.w", "box.h"))


def toggled(chosen: DataFrame, changes: DataFrame) -> DataFrame:
    """image_id and key in one of the two tables but not in both: one sum of the sides that hold them, added up where they are read, instead of joins. Nulls are equal."""
    keys = ["image_id", "key"]
    sides = chosen.select(*keys, F.lit(0).alias("_side")).unionByName(changes.select(*keys, F.lit(1).alias("_side")))
    return sides.groupBy(*keys).agg(F.min("_side").alias("_l"), F.max("_side").alias("_h")).where("_l = _h").select(*keys)


def review(automatic: DataFrame, excluded: DataFrame, manual: DataFrame, images: DataFrame) -> DataFrame:
    """image_id and box: automatic boxes (flattened) without the excluded keys, and manual ones (x, y, w, h), clamped to images (width, height)."""
    kept = automatic.join(excluded.select("image_id", "key").distinct(), ["image_id", "key"], "left_anti").select("image_id", *[F.col(f"box.{c}").cast("double").alias(c) for c in "xywh"])
    every = kept.unionByName(manual.select("image_id", *[F.col(c).cast("double").alias(c) for c in "xywh"]))
    box = clamped(*[F.col(c) for c in "xywh"], F.col("width"), F.col("height"))
    return every.join(images, "image_id").select("image_id", box.alias("box")).where("box is not null")


def valid_responses(words: DataFrame, images: DataFrame) -> DataFrame:
    """The words of responses that are wholly sound: all or nothing for each image (images: image_id, width, height)."""
    d = words.join(images, "image_id")
    run = Window.partitionBy("image_id").orderBy("word_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("image_id")
    size = F.sum(F.octet_length("text") + 1).over(run)
    sound = (
        F.col("text").rlike(r"(?U)\S") & ~F.col("text").contains("\0") & (size <= MAX_BYTES) & F.col("conf").between(0, 1) & ~F.isnan("conf")
        & (F.col("w") > 0) & (F.col("h") > 0) & (F.col("x") >= 0) & (F.col("y") >= 0)
        & (F.col("x").cast("long") + F.col("w") <= F.col("width")) & (F.col("y").cast("long") + F.col("h") <= F.col("height"))
    )
    d = d.withColumn("_ok", F.coalesce(sound, F.lit(False)))
    d = d.withColumn("_all", F.min("_ok").over(whole)).withColumn("_n", F.count("*").over(whole))
    return d.where(F.col("_all") & (F.col("_n") <= MOST_WORDS)).select(*words.columns)


RESPONSE = "width int, height int, words array<struct<text: string, x: int, y: int, w: int, h: int, conf: float>>"


def decoded_responses(responses: DataFrame) -> DataFrame:
    """Words of JSON responses (image_id, body, width, height); a response that is too large, malformed or of another size gives none."""
    parsed = F.from_json("body", RESPONSE, {"mode": "PERMISSIVE"})
    d = responses.where(F.octet_length("body") <= MOST_RESPONSE_BYTES).withColumn("r", parsed)
    known = F.forall(F.json_object_keys("body"), lambda k: k.isin("width", "height", "words"))
    d = d.where(known & (F.col("r.width") == F.col("width")) & (F.col("r.height") == F.col("height")) & F.col("r.words").isNotNull())
    words = d.select("image_id", "width", "height", F.posexplode("r.words").alias("word_ix", "p")).select("image_id", "word_ix", "p.*")
    return valid_responses(words, responses.select("image_id", "width", "height"))


def native_words(observations: DataFrame) -> DataFrame:
    """Observations (image_id, obs_ix, text, min_x, min_y, max_x, max_y in 0..1 from the lower left, conf, width, height) to words in pixels.

    Words are split at white space and keep their marks; each has its observation's rectangle unless its own is given.
    """
    d = observations.withColumn("t", F.filter(F.split("text", r"(?U)\s+"), lambda s: s != "")).select("*", F.posexplode("t").alias("k", "word"))
    clip = lambda v, most: F.greatest(F.lit(0.0), F.least(most.cast("double"), v))
    left, right = F.floor(clip(F.col("min_x") * F.col("width"), F.col("width"))), F.ceil(clip(F.col("max_x") * F.col("width"), F.col("width")))
    top, bottom = F.floor(clip((1 - F.col("max_y")) * F.col("height"), F.col("height"))), F.ceil(clip((1 - F.col("min_y")) * F.col("height"), F.col("height")))
    box = {"x": left, "y": top, "w": right - left, "h": bottom - top}
    ix = F.row_number().over(Window.partitionBy("image_id").orderBy("obs_ix", "k")) - 1
    return d.where((right > left) & (bottom > top)).select("image_id", ix.alias("word_ix"), F.col("word").alias("text"), *[v.cast("int").alias(c) for c, v in box.items()], "conf")


def rescaled(x: Column, y: Column, w: Column, h: Column, scale: Column, width: Column, height: Column) -> Column:
    """A detector's box in the image's own pixels, four a side at least, cut at the image's edges."""
    bx, by = F.floor(x / scale), F.floor(y / scale)
    bw, bh = F.greatest(F.floor(w / scale), F.lit(4)), F.greatest(F.floor(h / scale), F.lit(4))
    return F.struct(bx.cast("int").alias("x"), by.cast("int").alias("y"), F.least(bw, width - bx).cast("int").alias("w"), F.least(bh, height - by).cast("int").alias("h"))


def ctc_decoded(steps: DataFrame, letters: list[str]) -> DataFrame:
    """line_id, text and conf of greedy decoding: steps (line_id, step, logits); 0 is blank, repeats collapse; conf is the mean of the highest probabilities."""
    best = F.array_position("logits", F.array_max("logits")).cast("int") - 1
    peak = F.array_max("logits")
    total = F.aggregate("logits", F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - peak))
    w = Window.partitionBy("line_id").orderBy("step")
    d = steps.select("line_id", "step", best.alias("best"), (1 / total).alias("p")).withColumn("prev", F.lag("best").over(w))
    kept = d.where("best <> 0 and (prev is null or best <> prev)")
    table = F.array(*[F.lit(x) for x in letters])
    kept = kept.withColumn("letter", F.get(table, F.col("best") - 1)).where("letter is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "letter"))), lambda x: x["letter"]), "")
    return kept.groupBy("line_id").agg(text.alias("text"), F.avg("p").alias("conf"))
