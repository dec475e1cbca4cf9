"""Token-ID files: independent zstandard frames with a trailing seek table and per-frame checksums.

A shard holds the ids of a run of documents in ascending doc_id order. Its layout, byte for byte:

    frame 0, pad, frame 1, pad, ..., index frame, pad, seek table, pad

* A frame is one zstandard frame (content size and checksum on) of little-endian unsigned 32-bit ids of
  whole documents, each with its end id.
* pad is an empty skippable frame; any zstandard reader passes over it.
* The index frame is a zstandard frame of JSON: for each data frame the documents' ids and lengths.
* The seek table is a skippable frame of type 0x184D2A5E, as in the public seekable format: for each frame its
  compressed size (with pad), decompressed size and the low 32 bits of the content's XXH64; then the number of
  frames, a descriptor byte (0x80: checksums) and the magic number 0x8F92EAB1.

The pad lets Spark's own text writer write the shards: rows are frames, pad is the line separator. So writes go
through Spark's commit protocol (a lost executor's task is run again and nothing half-written stays) and reach every
store that Spark reaches.

Null texts are empty. Repeated rows are written as often as they occur; null ids come first. An empty table gives no
shard. Other columns are left out of the files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, docs_table, kept, materialize, new_path, small_batches, text_bytes

PAD = b"P*M\x18\x00\x00\x00\x00"
SEEK_MAGIC = 0x8F92EAB1
SKIP_MAGIC = 0x184D2A5E
END_ID = 0
#: Raw bytes of ids in a frame, but a longer document has a frame of its own.
FRAME_BYTES = 1 << 18
#: Bytes of text in a shard, about.
SHARD_BYTES = 32 << 20
#: A space beside other white space, or at the end.
BESIDE = re.compile(r"\s | \s| \Z")
RARE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
END = struct.pack("<I", END_ID)
#: Distinct pieces remembered by a worker.
PIECES = 450_000
# Letters and marks that the vocabulary's splitting rule takes for such.
_LETTERS, _MARKS = r"A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F", r".,;:!?|*$#%&()\-\"=@/+_"
#: A part that PIECE splits as that rule does: no other character, such as an apostrophe, and no white space but single line ends.
SIMPLE = re.compile(rf"(?:[{_LETTERS}0-9{_MARKS}]++|\n(?=\S))++")
PIECE = re.compile(rf"[{_LETTERS}]+|[0-9]+|[{_MARKS}]+|\n")
_STOPS = frozenset(".,;:!?")
#: The vocabulary writes a byte that isn't a visible Latin-1 character as the next free one from 256 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def beside(text: str) -> bool:
    """Whether a space stands beside other white space, or at the end; fast where the only white space is spaces and line ends."""
    if text.isascii() and not any(c in text for c in RARE):
        return "  " in text or "\n " in text or " \n" in text or text[-1:] == " "
    return BESIDE.search(text) is not None


class Memo(dict):
    """Pieces and their ids; when it is full the pieces it has, the frequent ones among them, stay."""

    def __init__(self, make: Callable[[str], bytes], limit: int = PIECES):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(self) < self.limit:
            self[piece] = ids
        return ids


class Encoder:
    """Text to ids as little-endian bytes, with the end id; pieces seen before aren't encoded again.

    The vocabulary's splitting rule always ends a piece before a space that follows a character that isn't white
    space, so a text may be cut there and the parts encoded alone. A text with a space beside other white space, or with
    one of the vocabulary's special tokens in it, is encoded whole. Parts of Latin letters, digits and marks are split
    by that rule here and their pieces go to the library's merges, all others to the whole library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.merges = self.tokenizer.model
        self.later = Memo(lambda w: self._part(w, True))
        self.first = Memo(lambda w: self._part(w, False), PIECES // 8)
        self.bare = Memo(self._piece, PIECES // 8)

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.merges.tokenize(piece.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _part(self, part: str, space: bool) -> bytes:
        if part.isascii():
            if part.isalpha():
                return array("I", [t.id for t in self.merges.tokenize(f"\u0120{part}" if space else part)]).tobytes()
            if space and part[-1:] in _STOPS and part[:-1].isalpha():  # a word and one mark, the most common by far
                return self.later[part[:-1]] + self.bare[part[-1]]
        if not SIMPLE.fullmatch(part):
            return self._whole(f" {part}" if space else part)
        pieces = PIECE.findall(part)
        if len(pieces) == 1:
            return self._piece(f" {part}" if space else part)
        return (self.later[pieces[0]] if space else self.bare[pieces[0]]) + b"".join(map(self.bare.__getitem__, pieces[1:]))

    def _ids(self, text: str) -> bytes:
        if beside(text) or any(x in text for x in self.special):
            return self._whole(text)
        head, *tail = text.split(" ")
        return self.first[head] + b"".join(map(self.later.__getitem__, tail))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._ids(t) + END for t in texts]


def encoder_of(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("tokens", path), lambda: Encoder(path))


def frames(docs: Iterator[tuple[int | None, bytes]], level: int = 3, frame_bytes: int = FRAME_BYTES) -> Iterator[bytes]:
    """The rows of a shard: frames, index frame, seek table; nothing for no documents."""
    z = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    index: list[list] = []
    table: list[bytes] = []
    held: list[bytes] = []
    names: list[list] = [[], []]
    size = 0

    def close() -> bytes:
        nonlocal held, names, size
        raw = b"".join(held)
        out = z.compress(raw)
        table.append(struct.pack("<III", len(out) + len(PAD), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        index.append(names)
        held, names, size = [], [[], []], 0
        return out

    for doc_id, ids in docs:
        if held and size + len(ids) > frame_bytes:
            yield close()
        held.append(ids)
        names[0].append(doc_id)
        names[1].append(len(ids) // 4)
        size += len(ids)
    if held:
        yield close()
    if not index:
        return
    raw = json.dumps(index, separators=(",", ":")).encode()
    out = z.compress(raw)
    table.append(struct.pack("<III", len(out) + len(PAD), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
    yield out
    body = b"".join(table) + struct.pack("<IBI", len(table), 0x80, SEEK_MAGIC)
    yield struct.pack("<II", SKIP_MAGIC, len(body)) + body


class Shard:
    """Reads a shard through read(offset, length); a document costs its frame only."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        self.read = read
        foot = read(size - len(PAD) - 9, 9)
        n, descriptor, magic = struct.unpack("<IBI", foot)
        if magic != SEEK_MAGIC or descriptor != 0x80:
            raise ValueError("not a token shard")
        table = np.frombuffer(read(size - len(PAD) - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw, self.sums = table[:, 0], table[:, 1], table[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)])
        self.z = zstandard.ZstdDecompressor()
        self.index = json.loads(self.frame(n - 1))

    @classmethod
    def of(cls, content: bytes | memoryview) -> "Shard":
        view = memoryview(content)
        return cls(lambda at, n: bytes(view[at : at + n]), len(content))

    def frame(self, k: int) -> bytes:
        """The content of frame k, its checksum proven."""
        raw = self.z.decompress(self.read(int(self.offsets[k]), int(self.sizes[k]) - len(PAD)), max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return raw

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        for k, (names, sizes) in enumerate(self.index):
            raw, at = self.frame(k), 0
            for doc_id, n in zip(names, sizes, strict=True):
                yield doc_id, raw[at : at + 4 * n]
                at += 4 * n

    def document(self, doc_id: int | None) -> bytes | None:
        """The ids of the first document of that id, decompressing one frame."""
        for k, (names, sizes) in enumerate(self.index):
            if doc_id in names:
                i = names.index(doc_id)
                at = 4 * sum(sizes[:i])
                return self.frame(k)[at : at + 4 * sizes[i]]
        return None


def write_tokens(docs: DataFrame, path: str, tokenizer: str, level: int = 3, shard_bytes: int = SHARD_BYTES) -> str:
    """Encode docs (doc_id, text) and write the shards to path; shards by their number hold ascending doc_ids."""
    # rows that share an id, or have none, are told apart by where they are read, so they too are cut to shards
    order = ["doc_id", "_p"]
    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.spark_partition_id().alias("_p"))
    shards = max(1, -(-text_bytes(docs) // shard_bytes))

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents() -> Iterator[tuple[int | None, bytes]]:
            encoder = encoder_of(tokenizer)
            for t in batches(it, 1 << 20):
                texts = [x or "" for x in t["text"].to_pylist()]
                yield from zip(t["doc_id"].to_pylist(), encoder.encode(texts), strict=True)

        for f in frames(documents(), level):
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.binary())], ["frame"])

    rows = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, "frame binary")
    rows.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", PAD.decode()).option("compression", "none").text(path)
    return path


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """One row per document from the shards: shard (file name), place in it, doc_id, local_start, n_tokens, ids_crc32, and ids if they are wanted."""
    names = ["shard", "place", "doc_id", "local_start", "n_tokens", "ids_crc32"] + ["ids"] * ids
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def decode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, content in zip(b["path"], b["content"], strict=True):
                content = memoryview(content.as_buffer())
                if not len(content):
                    continue
                at, rows = 0, []
                for place, (doc_id, raw) in enumerate(Shard.of(content).documents()):
                    rows.append((name.as_py().rpartition("/")[2], place, doc_id, at, len(raw) // 4, zlib.crc32(raw), *[raw] * ids))
                    at += len(raw) // 4
                    if len(rows) == 512:
                        yield table(rows)
                        rows = []
                if rows:
                    yield table(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(decode, "shard string, place long, doc_id long, local_start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the shards of path."""
    rows = materialize(read_tokens(spark, path, ids=False).select("shard", "doc_id", "local_start", "n_tokens", "ids_crc32"), "digest")
    return placed(rows)


def placed(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of rows (shard, doc_id, local_start, n_tokens, ids_crc32); shards in the order of their numbers."""
    rows = rows.withColumn("shard", F.regexp_extract("shard", r"^part-(\d+)", 1).cast("long"))
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded, written as shards in the shared folder, and read back."""
    path = new_path(spark, "tokens")
    write_tokens(docs_table(spark, sf_dir), path, default_tokenizer())
    return token_digest(spark, path)
