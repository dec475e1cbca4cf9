"""Removal of repeated passages by difference-cover anchors.

A window is a run of `window` words. Two equal windows at i and j have a shift d below the period with both i + d and
j + d at positions of the difference cover, so the anchors there (shorter runs of words that still lie in the windows)
are equal: only cover positions are hashed, and only windows around an anchor that occurs elsewhere are looked at
further. Those are hashed whole, in 96 bits, and counted; each word of a window that occurs twice goes.

Documents are dealt to blocks of a bounded size. A block sends each hash once with a place in the block, so a passage in
a third of all documents gives a row per block, not per occurrence. The places of repeated ones come back to the blocks,
where they meet the texts.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null and empty texts have no words; the hash of no words is that of the
empty string. Windows are judged on the input. Repeated rows repeat their windows, so both lose them. A null id is an
id like any other, rows apart. An empty table gives no rows. Extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Texts, as_bytes, dealt, docs_table, small_batches

WINDOW = 35
#: A difference cover: each number below PERIOD is a difference of two of COVER modulo PERIOD. Fixed values.
PERIOD, COVER = 21, (0, 1, 4, 14, 16)
#: Bytes of text in a block, about, and blocks at least.
BLOCK_BYTES, LEAST_BLOCKS = 4 << 20, 64


def anchors(t: Texts, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and their hashes."""
    length = window - PERIOD + 1
    covered = np.zeros(PERIOD, dtype=bool)
    covered[list(COVER)] = True
    at = np.flatnonzero(covered[t.place % PERIOD] & (t.left >= length))
    # 48 bits: what they let through is looked at whole
    return at, t.runs(length)[at] >> np.uint64(16)


def around(t: Texts, hit: np.ndarray, window: int) -> np.ndarray:
    """Starts of the windows that hold one of the anchors at hit."""
    mark = np.zeros(len(t.hashes) + PERIOD + 1, dtype=np.int64)
    mark[hit + 1] = 1
    upto = np.cumsum(mark)
    n = len(t.hashes)
    return np.flatnonzero((upto[PERIOD : PERIOD + n] > upto[:n]) & (t.left >= window))


def _sent(block: int, at: np.ndarray, *hashes: np.ndarray) -> pa.Table:
    """A row for each distinct hash of a block: the hash, and where: block, first place, and whether there are more, in one number."""
    # rows of one first hash and different second ones may stand mixed; then a hash has several rows, whose counts add up
    order = np.argsort(hashes[0], kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([h[order][1:] != h[order][:-1] for h in hashes], axis=0)
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(order))) > 1
    pick = order[first]
    place = (np.int64(block) << 33) | (at[pick] << 1) | many
    return pa.table({f"h{k}": pa.array(h[pick].view(np.int64) if h.dtype == np.uint64 else h[pick]) for k, h in enumerate(hashes, 1)} | {"place": pa.array(place)})


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """block and at of the rows whose hashes occur twice at least, over all blocks. A hash has a row for each block that has it."""
    n = F.sum(F.col("place").bitwiseAND(1) + 1).over(Window.partitionBy(*keys))
    return rows.withColumn("n", n).where("n > 1").select(F.shiftright("place", 33).cast("int").alias("block"), F.shiftright(F.col("place").bitwiseAND((1 << 33) - 1), 1).cast("int").alias("at"))


def _ordered(t: pa.Table) -> tuple[pa.Table, Texts]:
    """A block's documents, always in the same order, whatever order they came in."""
    order = pa.compute.sort_indices(t, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])
    t = t.take(order)
    return t, Texts(as_bytes(t["text"]))


def kept_words(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (word ranges removed, ends out) and kept (the text without them, its words joined by a space)."""
    rows = dealt(small_batches(docs).select("doc_id", "text"), BLOCK_BYTES, LEAST_BLOCKS)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), "block")

    def first(key: tuple, texts: pa.Table) -> pa.Table:
        _, t = _ordered(texts)
        at, h = anchors(t, window)
        return _sent(key[0].as_py(), at, h)

    def second(key: tuple, texts: pa.Table, hits: pa.Table) -> pa.Table:
        empty = np.empty(0, dtype=np.int64)
        if not hits.num_rows or not texts.num_rows:
            return _sent(0, empty, empty, empty.astype(np.int32))
        _, t = _ordered(texts)
        at, h = anchors(t, window)
        told = hits["at"].to_numpy()
        at = around(t, at[np.isin(h, h[np.searchsorted(at, told)])], window)
        return _sent(key[0].as_py(), at, *pair(t, at))

    def pair(t: Texts, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of the windows at some places."""
        return t.runs(window)[at], (t.runs(window, 1)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def third(key: tuple, texts: pa.Table, hits: pa.Table) -> pa.Table:
        texts, t = _ordered(texts)
        gone = np.zeros(len(t.hashes) + 1, dtype=np.int64)
        if hits.num_rows:
            told = hits["at"].to_numpy()
            h1, h2 = pair(t, np.arange(len(t.hashes)))
            at = np.flatnonzero((t.left >= window) & np.isin(h1, h1[told]))
            # the same window elsewhere in the block goes as well
            both = np.unique(np.rec.fromarrays([h1[told], h2[told]]))
            mine = np.rec.fromarrays([h1[at], h2[at]])
            at = at[both[np.minimum(np.searchsorted(both, mine), len(both) - 1)] == mine]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + window, -1)
        removed = np.cumsum(gone)[:-1] > 0
        spans, kept = [], []
        for text, a, b in zip(as_bytes(texts["text"]), t.starts, t.ends, strict=True):
            words, r = text.split(), removed[a:b]
            edge = np.flatnonzero(np.diff(np.concatenate([[0], r.astype(np.int8), [0]])))
            spans.append([{"start": int(i), "stop": int(j)} for i, j in edge.reshape(-1, 2)])
            kept.append(b" ".join([w for w, gone in zip(words, r.tolist(), strict=True) if not gone] if len(edge) else words))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        return pa.table({"doc_id": texts["doc_id"], "n_words": pa.array(t.lengths), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    by = lambda: rows.groupBy("block")
    found = repeated(by().applyInArrow(first, "h1 long, place long"), ["h1"])
    found = repeated(by().cogroup(found.groupBy("block")).applyInArrow(second, "h1 long, h2 int, place long"), ["h1", "h2"])
    return by().cogroup(found.groupBy("block")).applyInArrow(third, "doc_id long, n_words long, spans array<struct<start: int, stop: int>>, kept binary")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents without its repeated windows."""
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")
    return kept_words(docs_table(spark, sf_dir)).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
dup AS (SELECT k FROM win GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN dup USING (k)) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p, ps FROM d LEFT JOIN gone USING (doc_id)) WHERE ps IS NULL OR NOT list_contains(ps, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
