"""Benchmark decontamination with an FM-index per training shard.

Each task turns its documents into runs of words that occur in the benchmark (a window holds no other word, so no
occurrence crosses one), joins the runs to one text with a separator after each, and builds an FM-index of it: the
Burrows-Wheeler transform in a wavelet matrix, counts before each symbol, and sampled suffix positions. The benchmark's
windows are searched backwards, all at once, by wavelet ranks; occurrences are located by walking to the next sampled
suffix; their spans are merged into the spans to remove.

Words are lower-cased (A-Z) runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`. A window is 13 consecutive words of an item; an
item of fewer, but not none, is one window. Null and empty texts have no words and no hits. Items of the same id count
once; items with a null id mark words but aren't listed. Repeated documents are judged each for itself. No documents
give no rows; an empty benchmark hits nothing. Extra columns of documents are kept by decontaminate(), whatever their names.

The benchmark is the stated query set: it is searched in blocks of a bounded size, one after the other, each against all
documents; the driver and the executors hold one block at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, batches, docs_table, materialize, small_batches

WINDOW = 13
#: Bytes of text indexed at once by a task.
SHARD_BYTES = 16 << 20
#: Bytes of benchmark text searched at once; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 4 << 20
#: Every so many suffix positions is kept.
SAMPLE = 8

#: Upper case to lower case, and all that is no word character to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class WaveletMatrix:
    """Ranks over a sequence of symbols below 2**bits, for arrays of positions."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ranks = bits, [], []
        s = symbols
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            rank = np.zeros(len(s) + 1, dtype=np.int32)  # a shard has far fewer symbols than 2**31
            np.cumsum(bit, out=rank[1:])
            self.ranks.append(rank)
            self.zeros.append(len(s) - int(rank[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before position at."""
        start = np.zeros(len(at), dtype=np.int64)
        for k in range(self.bits):
            rank, one = self.ranks[k], (symbol >> (self.bits - 1 - k)) & 1 == 1
            at = np.where(one, self.zeros[k] + rank[at], at - rank[at])
            start = np.where(one, self.zeros[k] + rank[start], start - rank[start])
        return at - start

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for k in range(self.bits):
            rank = self.ranks[k]
            one = rank[at + 1] - rank[at] == 1
            out = (out << 1) | one
            at = np.where(one, self.zeros[k] + rank[at], at - rank[at])
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; a suffix that ends sorts before its extensions."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1
    order, step = np.argsort(rank, kind="stable"), 1
    while n:
        key = rank * (n + 2)
        key[: n - step] += rank[step:] if step < n else 0
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[1], 1 + np.cumsum(k[1:] != k[:-1])])
        rank = new
        if rank.max(initial=0) == n:
            break
        step *= 2
    return order


class FMIndex:
    """Backward search over a text of symbols 1..size-1; 0 is the end."""

    def __init__(self, text: np.ndarray, size: int):
        text = np.append(text, 0).astype(np.int64)
        sa = suffix_array(text)
        bwt = text[sa - 1]
        self.wavelet = WaveletMatrix(bwt, max(1, int(size - 1).bit_length()))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))])
        kept = sa % SAMPLE == 0
        self.kept = np.concatenate([[0], np.cumsum(kept)])
        self.samples = sa[kept]
        self.n = len(text)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of patterns, right-aligned rows of a matrix."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        width = patterns.shape[1]
        for k in range(width):
            live = np.flatnonzero((lengths > k) & (low < high))
            if not len(live):
                break
            c = patterns[live, width - 1 - k]
            low[live] = self.before[c] + self.wavelet.rank(c, low[live])
            high[live] = self.before[c] + self.wavelet.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: back to the next sampled suffix."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(self.kept[at + 1] == self.kept[at])
        while len(todo):
            c = self.wavelet.access(at[todo])
            at[todo] = self.before[c] + self.wavelet.rank(c, at[todo])
            steps[todo] += 1
            todo = todo[self.kept[at[todo] + 1] == self.kept[at[todo]]]
        return self.samples[self.kept[at]] + steps


class Phrases:
    """The windows of a block of the benchmark, as rows of word numbers."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        texts = [np.array([self.number.setdefault(w, len(self.number) + 2) for w in words_of(text or b"")], dtype=np.int32) for _, text in items]
        self.size = len(self.number) + 2
        self.names = [item for item, _ in items]
        rows = [np.zeros((0, window), dtype=np.int32)]
        for ids in texts:
            n = min(window, len(ids))
            part = np.zeros((len(ids) - n + 1 if n else 0, window), dtype=np.int32)
            if n:
                part[:, window - n :] = np.lib.stride_tricks.sliding_window_view(ids, n)
            rows.append(part)
        owner = np.repeat(np.arange(len(texts)), [len(r) for r in rows[1:]])
        # a word's number isn't 0, so rows that are padded differ from those that aren't
        every = np.ascontiguousarray(np.concatenate(rows))
        _, first, which = np.unique(every.view(np.dtype((np.void, every.dtype.itemsize * window))).ravel(), return_index=True, return_inverse=True)
        self.patterns = every[first]
        self.lengths = (self.patterns > 0).sum(axis=1)
        order = np.argsort(which, kind="stable")
        #: The items of pattern p are owner[cut[p]:cut[p + 1]], numbers of names.
        self.owner, self.cut = owner[order], np.searchsorted(which[order], np.arange(len(first) + 1))
        self.least = int(self.lengths.min(initial=window))

    def items(self, patterns: np.ndarray) -> set:
        return {self.names[i] for p in patterns.tolist() for i in self.owner[self.cut[p] : self.cut[p + 1]].tolist()}

    def spans(self, docs: list[np.ndarray]) -> list[tuple[np.ndarray, set]]:
        """For each document (word numbers, 0 where the benchmark lacks the word): merged hit spans and the items hit."""
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        flat = np.zeros(int(starts[-1]), dtype=np.int64)
        for at, d in zip(starts, docs, strict=False):
            flat[at : at + len(d)] = d
        known = np.concatenate([[0], (flat > 0).astype(np.int8), [0]])
        edge = np.diff(known)
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = stop - begin >= self.least
        begin, stop = begin[long], stop[long]
        out = [(np.empty((0, 2), dtype=np.int64), set()) for _ in docs]
        if not len(begin) or not len(self.lengths):
            return out
        size = stop - begin + 1  # with a separator, symbol 1
        at = np.cumsum(size) - size
        text = np.ones(int(size.sum()), dtype=np.int64)
        source = np.repeat(begin - at, size) + np.arange(len(text))
        inside = np.ones(len(text), dtype=bool)
        inside[at + size - 1] = False
        text[inside] = flat[source[inside]]
        index = FMIndex(text, self.size)
        low, high = index.search(self.patterns, self.lengths)
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return out
        count = high[hit] - low[hit]
        which = np.repeat(hit, count)
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)
        place = source[index.locate(rows)]
        order = np.argsort(place, kind="stable")
        place, which = place[order], which[order]
        doc = np.searchsorted(starts, place, side="right") - 1
        end = place + self.lengths[which]
        cut = np.flatnonzero(np.diff(doc, prepend=-1))
        for i, j in zip(cut, np.append(cut[1:], len(doc)), strict=True):
            d = doc[i]
            s, e = place[i:j] - starts[d], np.maximum.accumulate(end[i:j]) - starts[d]
            first = np.concatenate([[True], s[1:] > e[:-1]])
            last = np.append(np.flatnonzero(first)[1:] - 1, len(s) - 1)
            out[d] = (np.stack([s[first], e[last]], axis=1), self.items(np.unique(which[i:j])))
        return out


SPANS = "array<struct<start: int, stop: int>>"


def hit_spans(docs: DataFrame, benchmark: DataFrame, key: str, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_words, spans (word ranges to remove, merged) and items (ids hit, as strings) for every row of docs (key, text)."""
    size = benchmark.select(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks == 1:
        return _search(docs, _phrases(benchmark, window), key)[0]
    # written, so that a row has the same number for every block; ids may repeat or be null
    rows = materialize(docs.select(key, "text").withColumn("_row", F.monotonically_increasing_id()), "numbered")
    # dealt by id and text, so that neither items of one text nor repeated rows fill a block
    items = benchmark.select("item_id", "text").distinct()
    every = None
    for b in range(blocks):
        # one block at a time is on the driver and with the executors: its hits are written, then it goes
        part, shared = _search(rows, _phrases(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), window), "_row")
        part = materialize(part if b == 0 else part.where(F.size("spans") > 0), "hits")
        shared.destroy()
        every = part if every is None else every.unionByName(part)
    found = every.groupBy("_row").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("_row", key).join(found, "_row").select(key, "n_words", merged("spans").alias("spans"), "items")


def _phrases(items: DataFrame, window: int) -> Phrases:
    return Phrases([(r[0], r[1]) for r in items.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator()], window)


def merged(spans: str):
    """Overlapping and touching spans of an array joined."""
    return F.expr(
        f"aggregate(array_sort({spans}), cast(array() as {SPANS}), (acc, x) -> case when size(acc) > 0 and element_at(acc, -1).stop >= x.start"
        " then concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'stop', greatest(element_at(acc, -1).stop, x.stop)))) else concat(acc, array(x)) end)"
    )


def _search(docs: DataFrame, phrases: Phrases, key: str) -> tuple[DataFrame, Broadcast]:
    """What hit_spans() gives for the items of one block, and the broadcast that holds these."""
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(phrases)  # bounded by BLOCK_BYTES of benchmark text

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        number = p.number
        for t in batches(it, SHARD_BYTES):
            docs, counts = [], []
            for text in as_bytes(t["text"]):
                w = words_of(text)
                counts.append(len(w))
                docs.append(np.fromiter((number.get(x, 0) for x in w), dtype=np.int32, count=len(w)))
            found = p.spans(docs)
            spans = pa.array([[{"start": int(a), "stop": int(b)} for a, b in s] for s, _ in found], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
            items = pa.array([sorted(i for i in s if i is not None) for _, s in found], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([t[key].combine_chunks(), pa.array(counts, pa.int64()), spans, items], [key, "n_words", "spans", "items"])

    return small_batches(docs).select(key, "text").mapInArrow(run, f"`{key}` {kind}, n_words long, spans {SPANS}, items array<string>"), shared


def n_hit():
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.stop - s.start)")


def contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs without their contaminated rows; all columns as they were."""
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    found = _rows_kept(inner, benchmark, window)
    return found.select("row.*")


def _rows_kept(inner: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    found = hit_spans(inner, benchmark, "row", window)
    return found.withColumn("n_hit", n_hit()).where(~contaminated())


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all benchmark windows in every whole text of documents."""
    found = hit_spans(docs_table(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "doc_id").withColumn("n_hit", n_hit())
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS k FROM b WHERE len(w) > 0),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
hit AS (SELECT DISTINCT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.k = bw.k),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
