"""Language ID by compression: the language whose zstandard raw-content dictionary makes a text smallest.

A model holds one dictionary per language, made of a bounded sample of labelled rows. A text is folded to lower-case
letters and their marks with single spaces, cut into chunks, and each chunk is compressed alone against each dictionary,
so the dictionaries count for the whole of a long text and not for its beginning only. The language of the smallest sum
is chosen; the relative gap to the second gives the score; a gap below the least margin means that the text is rejected.

The sample: a language's distinct labelled texts, whole, in the order of their hashes (those larger than the bound last),
until their bytes reach the bound dictionary_bytes, or the texts the bound rows. A language of whose labelled texts none has a letter isn't learned.

A null text or one without letters is `und`, score 0, rejected. Ties go to the language first by code point. Labels that
are null aren't learned. Repeated rows are predicted alike, and learned once. An empty table gives no rows; without
labelled rows every text is `und`. Extra columns are kept by keep_identified(), whatever their names. Only the text is
an input of a prediction.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import docs_table, fold_of, materialize, small_batches

UNKNOWN = "und"
NOT_LETTERS, NOT_ASCII_LETTERS = regex.compile(r"[^\p{L}\p{M}]+"), re.compile(r"[^a-z]+")


def folded(text: str | None) -> bytes:
    t = (text or "").lower()
    t = (NOT_ASCII_LETTERS if t.isascii() else NOT_LETTERS).sub(" ", t).strip()
    return t.encode() if any(map(str.isalpha, t)) else b""


class LanguageModel:
    """Dictionaries by language and the compressors made from them, which stay behind when it is pickled."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 12, chunk: int = 2048):
        self.dictionaries, self.level, self.chunk = dict(sorted(dictionaries.items())), level, chunk
        self._made: dict | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": None}

    def compressors(self) -> dict[str, zstandard.ZstdCompressor]:
        if self._made is None:
            self._made = {}
            for lang, raw in self.dictionaries.items():
                d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=self.level)
                self._made[lang] = zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        return self._made

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin: the relative gap between the smallest and the second smallest encoding."""
        raw = folded(text)
        made = self.compressors()
        if not raw or not made:
            return UNKNOWN, 0.0
        chunks = [raw[i : i + self.chunk] for i in range(0, len(raw), self.chunk)]
        sizes = sorted((sum(len(c.compress(p)) for p in chunks), lang) for lang, c in made.items())
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0


def fit(labelled: DataFrame, rows: int = 500, dictionary_bytes: int = 65536, **model: int) -> LanguageModel:
    """A model of labelled (text, lang), learned from a sample of whole distinct texts of each language: at most rows of them, and no more once they have dictionary_bytes."""
    size = F.octet_length("text")
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64("text").alias("h"), size.alias("n"), (size > dictionary_bytes).alias("long"))
    every = materialize(known.where(F.col("text").rlike(r"\p{L}")).select("lang", "h", "n", "long").distinct(), "distinct")
    # of very many only hashes in so small a share of all are ranked as hold four times the rows wanted
    share = [((F.col("lang") == r["lang"]) & (F.col("long") == r["long"]), 4 * rows / r["k"]) for r in every.groupBy("lang", "long").agg(F.count("*").alias("k")).collect() if r["k"] > 4 * rows]
    for those, part in share:
        every = every.where(~those | (F.col("h") < int((part - 0.5) * 2.0**64)))
    first = Window.partitionBy("lang").orderBy("long", "h")
    drawn = every.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= rows)
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    picked = drawn.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("before") < dictionary_bytes).select("h").distinct()
    hashes = [r[0] for r in picked.collect()]
    sample = known.where(F.col("h").isin(hashes)).select("lang", "long", "h", "text").dropDuplicates(["lang", "h"]) if hashes else known.limit(0)
    texts: dict[str, list[tuple]] = {}
    for r in sample.collect():
        texts.setdefault(r["lang"], []).append((r["long"], r["h"], folded(r["text"])))
    out: dict[str, bytes] = {}
    for lang, t in texts.items():
        raw, size = b"", 0
        for _, _, x in sorted(t):
            if size >= dictionary_bytes:
                break
            raw, size = raw + b" " * bool(raw and x) + x, size + len(x)
        if raw:
            out[lang] = raw if len(raw) >= 8 else (raw + b" ") * 8  # zstandard takes no less
    return LanguageModel(out, **model)


def predict(docs: DataFrame, model: LanguageModel, key: str, min_margin: float = 0.003) -> DataFrame:
    """key, lang_pred, score (0 to 1), margin and rejected for every row of docs (key, text)."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # dictionary_bytes a language

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in it:
            got = [m.predict(t) for t in b["text"].to_pylist()]
            margin = [g for _, g in got]
            yield pa.RecordBatch.from_arrays(
                [b[key], pa.array([x for x, _ in got], pa.string()), pa.array([1 - math.exp(-g / 0.08) for g in margin], pa.float64()), pa.array(margin, pa.float64()), pa.array([x == UNKNOWN or g < min_margin for x, g in got], pa.bool_())],
                [key, "lang_pred", "score", "margin", "rejected"],
            )

    return small_batches(docs).select(key, "text").mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, margin double, rejected boolean")


def keep_identified(docs: DataFrame, model: LanguageModel, min_margin: float = 0.003) -> DataFrame:
    """docs without the rows whose language is rejected; all columns as they were."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return predict(rows, model, "row", min_margin).where(~F.col("rejected")).select("row.*")


def learnable(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: those whose crc32(doc_id as text) mod 5 isn't 0."""
    return docs.where(fold_of(F.col("doc_id"), 5) != 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = docs_table(spark, sf_dir)
    rows = docs.select(F.struct("doc_id", (F.coalesce(fold_of(F.col("doc_id"), 5), F.lit(0)) == 0).alias("held_out")).alias("row"), "text")
    return predict(rows, fit(learnable(docs)), "row").select("row.doc_id", "row.held_out", "lang_pred", "score", "margin", "rejected")
