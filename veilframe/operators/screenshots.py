"""From images to what must be blacked out in them: normalised, read by a recogniser, protected as text, mapped to boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import layout
from .images import normalised
from .protect import protect_each
from .rules import Rules

_WORD = [("word_ix", pa.int32()), ("text", pa.string()), ("x", pa.int32()), ("y", pa.int32()), ("w", pa.int32()), ("h", pa.int32()), ("conf", pa.float32())]


def recognised(images: DataFrame, recogniser: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Words (image_id, word_ix, text, x, y, w, h, conf) of images (image_id, content: PNG). recogniser: a PNG's bytes to (text, x, y, w, h, conf) in reading order."""
    kind = images.schema["image_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids, words = [], []
            for i, content in enumerate(b["content"].to_pylist()):
                found = recogniser(content) if content else []
                ids += [i] * len(found)
                words += [(k, *w) for k, w in enumerate(found)]
            columns = list(zip(*words, strict=True)) or [[]] * len(_WORD)
            yield pa.RecordBatch.from_arrays([b["image_id"].take(pa.array(ids, pa.int64())), *[pa.array(c, t) for c, (_, t) in zip(columns, _WORD, strict=True)]], ["image_id", *[n for n, _ in _WORD]])

    return images.select("image_id", "content").mapInArrow(run, f"image_id {kind}, word_ix int, text string, x int, y int, w int, h int, conf float")


def detected_words(words: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """image_id, text (protected), status, count, kinds and redactions (token and boxes) of recognised words, each image a session of its own. Boxes are those of every alias in an image's text. Words are gathered by image once; all else is worked out beside them."""
    pages = layout.paged(layout.joined(words)).withColumn("page", F.col("text"))
    shown = protect_each(pages, rules)
    none = F.expr("cast(array() as array<struct<token: string, boxes: array<struct<x: int, y: int, w: int, h: int>>>>)")
    redactions = F.coalesce(layout.boxes_within(F.col("page"), F.col("words"), F.col("mappings")), none)
    return shown.select("image_id", "text", "status", "count", "kinds", redactions.alias("redactions"))


def detected_images(images: DataFrame, recogniser: Callable[[bytes], list[tuple]], rules: Rules = Rules()) -> DataFrame:
    """detected_words() of images (image_id, content), each a session of its own; those that can't be decoded, or hold no words, give no row."""
    return detected_words(recognised(normalised(images).where("status = 'ok'"), recogniser), rules)
