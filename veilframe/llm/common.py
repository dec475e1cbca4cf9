"""What the corpus operators share: shared storage, sizes, word rules and hashes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1

#: Java regular expression of a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset: one of our own in local mode (tests), else an error, as no other folder is known to be shared."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="veilframe-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        got = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of ours from the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove what materialize() wrote; only for tables that no DataFrame still to be run reads."""
    for t in tables:
        if path := getattr(t, "_written_at", None):
            delete(t.sparkSession, path)


def small_batches(df: DataFrame) -> DataFrame:
    """df, its session told to hand Python Arrow batches of 2 MB at most: rows of texts differ a thousandfold in length. A lower value of the caller's stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key)
    if not (now.isdigit() and 0 < int(now) <= 2 << 20):
        conf.set(key, str(2 << 20))
    return df


def docs_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.select(F.sum(F.octet_length(F.col(text))).alias("b")).first()["b"] or 0


def fold_of(doc_id: Column, k: int) -> Column:
    """crc32(doc_id as text) mod k."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


#: Parts by whose sizes rows that are alike are noticed.
PARTS = 1 << 14


def dealt(docs: DataFrame, block_bytes: int, least: int) -> DataFrame:
    """docs with block: a number that deals rows to blocks of about block_bytes of text, the same whenever docs is read.

    A row's block comes from its id and text, so rows that share an id or have none spread. Rows that are alike in both
    would meet in one block; where a block is found to be far too large for that, rows are numbered and written, and
    dealt by number.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    fine = F.xxhash64("doc_id", F.xxhash64("text"))
    parts = docs.groupBy(F.pmod(fine, F.lit(PARTS))).agg(F.sum(size).cast("long").alias("b")).agg(F.sum("b").alias("all"), F.max("b").alias("most")).first()
    total, most = parts["all"] or 0, parts["most"] or 0
    blocks = F.lit(max(least, -(-total // block_bytes)))
    if most > 8 * block_bytes + 4 * total / PARTS:
        numbered = materialize(docs.withColumn("_number", F.monotonically_increasing_id()), "numbered")
        return numbered.withColumn("block", F.pmod(F.xxhash64("_number"), blocks).cast("int")).drop("_number")
    return docs.withColumn("block", F.pmod(fine, blocks).cast("int"))


#: ASCII white space.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes of a word that are hashed column by column; longer words are hashed one by one.
SHORT = 64


def hashed_words(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw and a 64-bit hash of each, without an object for each word."""
    a = np.frombuffer(raw, dtype=np.uint8)
    edge = np.diff(np.concatenate([[0], (~SPACE[a]).view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return starts, ends, hashed_ranges(a, raw, starts, ends)


def hashed_ranges(a: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes."""
    size = ends - starts
    order = np.argsort((SHORT + 1 - np.minimum(size, SHORT + 1)).astype(np.uint8), kind="stable")  # longest first
    at, left = starts[order], size[order]
    h = np.zeros(len(starts), dtype=np.uint64)
    more = np.searchsorted(-left, -np.arange(1, SHORT + 1), side="right") if len(left) else np.zeros(SHORT, dtype=np.int64)
    for k in range(SHORT):  # words of more than k bytes
        n = int(more[k])
        if not n:
            break
        h[:n] = h[:n] * np.uint64(0x9E3779B97F4A7C15) + a[at[:n] + k] + np.uint64(1)
    h = mix(h)
    for i in np.flatnonzero(left > SHORT).tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[at[i] : at[i] + left[i]])
    out = np.empty_like(h)
    out[order] = h
    return out


class Texts:
    """The words of some documents in one row, as hashes."""

    def __init__(self, texts: list[bytes]):
        self.raw = b"\n".join([*texts, b""])
        self.begin, self.stop, self.hashes = hashed_words(self.raw)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.empty(0, dtype=np.int64)
        self.ends = np.searchsorted(self.begin, ends)
        self.lengths = np.diff(self.ends, prepend=0)
        self.starts = self.ends - self.lengths
        self.place = np.arange(len(self.hashes)) - np.repeat(self.starts, self.lengths)
        self.left = np.repeat(self.ends, self.lengths) - np.arange(len(self.hashes))

    def runs(self, length: int, seed: int = 0) -> np.ndarray:
        """Hash of the run of length words from each word on; only where left >= length does it count."""
        h = windows(self.hashes, length, seed)
        return np.concatenate([h, np.zeros(len(self.hashes) - len(h), dtype=np.uint64)])


#: What this worker process keeps from task to task: one operator's at a time, so that idle workers don't hold several.
_KEPT: dict = {}


def kept(key: tuple, make: Callable[[], object]) -> object:
    """The worker's object of that key, made where it isn't there; another key's goes."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64, elementwise."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """Hash of the length words from each position on, by doubling; n - length + 1 values, none if the text is shorter."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    power, have, at, out = h + np.uint64(seed), 1, 0, None
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    while True:
        if length & have:
            part = power[at : at + n]
            out = part.copy() if out is None else mix(out * base + part)
            at += have
        if at >= length:
            return out
        power = mix(power[:-have] * base + power[have:]) if len(power) > have else power[:0]
        have *= 2


def batches(it: Iterator[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Arrow batches joined to tables of about limit bytes, or cut to that where a batch is larger."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in it:
        per = max(1, b.num_rows * limit // max(1, b.nbytes))
        for i in range(0, b.num_rows, per):
            part = b.slice(i, per)
            held.append(part)
            size += part.nbytes
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def as_bytes(column: pa.ChunkedArray) -> list[bytes]:
    """Texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def longs(a: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's longs."""
    return pa.array(a.astype(np.uint64).view(np.int64))
