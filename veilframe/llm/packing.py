"""Best-fit packing: documents' tokens into as few sequences of a fixed length as can be, by patterns of lengths.

Only documents longer than a sequence are cut, into whole sequences and a rest. How many pieces have which length is a
histogram of as many bars as a sequence has tokens, whatever the corpus; all that is decided here is decided on it:

1. Patterns are enumerated: one, two or three lengths that occur and fill a sequence, wholly or nearly.
2. Non-negative least squares fits how often each is repeated, so that together they use up the histogram's long
   pieces, but for a share that is kept with the short ones for step 4.
3. The repeats are rounded, patterns of the same longest piece together, so that their sum is kept, and no length is
   used more often than it occurs.
4. What is left goes best-fit, longest first, into the room that is left and into new
   sequences; equal pieces and equal rooms are handled as counts, so this too depends on lengths alone.

The result is a list of slots: so many consecutive pieces of one length go to so many consecutive sequences at one
offset. Pieces are numbered within their length and look up their slots, each where it is. The number is exact without a
window over all pieces of a length: tasks number theirs while they encode, and add what the tasks before them have.

Null texts are empty: their only token is the end id. Rows that share an id, or have none, are documents of their own.
An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches, docs_table, kept, materialize, small_batches
from .tokens import BYTE_CHARS, END

LENGTH = 2048
#: Tokens that a pattern may leave empty.
WASTE = 32
#: Share of the pieces that is fitted, and the part of a sequence under which a piece isn't: the others fill what room is left.
SHARE, SHORT = 0.8, 8
#: Steps of the fit.
STEPS = 300
# Latin letters that are their own composed form and whose lower case is one letter among them.
_LATIN = r"\u00DF-\u00F6\u00F8-\u012F\u0132-\u017F"
#: Words that SPLIT, after lower case, splits as the vocabulary's rule does: of these letters and of visible ASCII.
SIMPLE = re.compile(rf"[!-~\u00C0-\u00D6\u00D8-\u00DE{_LATIN}]+")
SPLIT = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[a-z{_LATIN}]+|[0-9]|[^a-z0-9{_LATIN}]+")
MARKS = frozenset(b".,;:!?")
#: What a text holds that isn't put in lower case as bytes: the start of a special token, first bytes of combining marks.
UNFOLDED = (b"<|", b"\xcc", b"\xcd")
#: Distinct words remembered by a worker.
WORDS = 600_000


class Words(dict):
    """Ids of the words met so far, made where they are missing; when it is full the words it has, the frequent ones among them, stay."""

    def __init__(self, tokenizer, limit: int = WORDS):
        super().__init__()
        self.tokenizer, self.merges, self.limit = tokenizer, tokenizer.model, limit
        self.special = tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())

    def _merged(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.merges.tokenize(piece)]).tobytes()

    def _split(self, word: bytes) -> bytes:
        text = word.decode()
        if SIMPLE.fullmatch(text) and not any(s in text for s in self.special):
            pieces = SPLIT.findall(text.lower())
            return b"".join([self._merged(p if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARS)) for p in pieces])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():
            ids = array("I", [t.id for t in self.merges.tokenize(word.lower().decode())]).tobytes()
        elif word[-1] in MARKS and word[:-1].isalpha():  # a word and one mark, the most common by far
            ids = self[word[:-1]] + self[word[-1:]]
        else:
            ids = self._split(word)
        if len(self) < self.limit:
            self[word] = ids
        return ids


class Encoder:
    """Text to ids as little-endian bytes, with the end id, for a vocabulary that drops white space and case.

    No piece of the vocabulary's splitting rule crosses white space, and neither composition nor lower case looks across
    it, so what stands between ASCII white space is encoded alone, and only once while it is remembered. Words of ASCII
    or Latin letters and visible ASCII are split by that rule here and go to the library's merges, all others, and those
    that may hold a special token, to the whole library. ASCII letters are put in lower case before where that can't
    make a special token or another composed letter.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.words = Words(Tokenizer.from_file(path))

    def encode(self, text: bytes) -> bytes:
        if not any(x in text for x in UNFOLDED):
            text = text.lower()
        return b"".join(map(self.words.__getitem__, text.split())) + END


def encoder_of(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file; it outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kept(("words", path), lambda: Encoder(path))


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length and ids of every piece, with part and rank: the task that made it and its place among that task's of its length. Written, so that these stay."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = encoder_of(tokenizer), TaskContext.get().partitionId(), Counter()
        names = ["doc_id", "piece", "start", "length", "ids", "part", "rank"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        rows, size = [], 0
        for t in batches(it, 1 << 20):
            for doc_id, text in zip(t["doc_id"].to_pylist(), t["text"].cast(pa.binary()).to_pylist(), strict=True):
                ids = encoder.encode(text or b"")
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    own = ids[at : at + 4 * length]
                    n = len(own) // 4
                    rows.append((doc_id, k, at // 4, n, own, part, seen[n]))
                    seen[n] += 1
                    size += len(own)
                    if size > 1 << 20:
                        yield table(rows)
                        rows, size = [], 0
        if rows:
            yield table(rows)

    docs = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(docs.mapInArrow(run, "doc_id long, piece int, start long, length int, ids binary, part int, rank long"), "pieces")


def patterns(counts: np.ndarray, waste: int = WASTE) -> np.ndarray:
    """Rows of one to three lengths that occur, falling, 0 for none: for each longest piece those that fill a sequence as nearly as any with it, but for waste tokens. counts: pieces by length, the last a whole sequence's."""
    full = len(counts) - 1
    present = np.flatnonzero(counts[:full])
    present = present[present > 0]
    largest = np.zeros(full + 1, dtype=np.int64)  # the largest length that occurs up to each
    largest[present] = present
    largest = np.maximum.accumulate(largest)
    out = [np.array([[full, 0, 0]])] if counts[full] else [np.empty((0, 3), dtype=np.int64)]
    for a in present[::-1].tolist():
        b = np.concatenate([[0], present[: np.searchsorted(present, min(a, full - a), side="right")]])
        c = largest[np.minimum(b, full - a - b)]
        empty = full - a - b - c
        if empty.min() <= waste:
            best = empty == empty.min()
            out.append(np.stack([np.full(int(best.sum()), a), b[best], c[best]], axis=1))
    return np.concatenate(out)


def least_squares(p: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeats >= 0 of the patterns whose use of lengths comes nearest to counts, by accelerated projected gradients."""
    if not len(p):
        return np.zeros(0)
    size = len(counts)
    used = lambda x: sum(np.bincount(p[:, k], weights=x, minlength=size) for k in range(3)) * (np.arange(size) > 0)
    back = lambda r: r[p].sum(axis=1)  # noqa: E731  r[0] is 0: no piece
    v = np.ones(len(p))
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(used(v))
        norm = np.linalg.norm(v)
        v /= norm
    step, x, ahead, t = 1 / (1.05 * norm), np.zeros(len(p)), np.zeros(len(p)), 1.0
    for _ in range(steps):
        new = np.maximum(ahead - step * back(used(ahead) - counts), 0.0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(p: np.ndarray, x: np.ndarray, counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Patterns with whole repeats, and the counts that they leave. Fractions are carried on among patterns of the same longest piece."""
    left, out = counts.copy(), []
    order = np.lexsort((-x, -p[:, 0])) if len(p) else []
    carry, of = 0.0, -1
    for i in order:
        if p[i, 0] != of:
            carry, of = 0.5, p[i, 0]
        carry += x[i]
        if carry < 1:
            continue
        need = Counter(int(v) for v in p[i] if v)
        n = min(int(carry), *[int(left[v]) // k for v, k in need.items()])
        carry -= int(carry)
        if n:
            out.append((tuple(int(v) for v in p[i] if v), n))
            for v, k in need.items():
                left[v] -= n * k
    return out, left


def best_fit(begun: list[tuple[tuple[int, ...], int]], left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """begun (patterns with repeats) completed by the pieces that are left: longest first, each to the fullest sequence that has room."""
    full = len(left) - 1
    room: dict[int, list[list]] = defaultdict(list)
    for p, n in begun:
        room[full - sum(p)].append([p, n])
    for size in np.flatnonzero(left)[::-1].tolist():
        todo, at = int(left[size]), size
        while todo:
            while at < full and not room[at]:
                at += 1
            each = at // size  # so many in a row go to one sequence, as it stays the fullest with room
            p, n = room[at][-1] if room[at] else ((), -(-todo // each))
            whole = min(n, todo // each)
            if room[at]:
                room[at].pop()
            if whole:
                room[at - each * size].append([p + (size,) * each, whole])
                todo -= whole * each
            if n > whole and todo and todo < each:
                room[at - todo * size].append([p + (size,) * todo, 1])
                todo, whole = 0, whole + 1
            if n > whole and p:
                room[at].append([p, n - whole])
    return [(p, n) for groups in room.values() for p, n in groups]


def plan(counts: np.ndarray, share: float = SHARE) -> list[tuple[tuple[int, ...], int]]:
    """Patterns and how many sequences follow each; together they hold all pieces. counts[k]: pieces of k tokens; the last is a whole sequence's."""
    full = len(counts) - 1
    fitted = (counts * share).astype(np.int64)
    fitted[: full // SHORT] = 0
    fitted[full] = counts[full]
    p = patterns(fitted)
    begun, left = rounded(p, least_squares(p, fitted), fitted)
    return best_fit(begun, left + counts - fitted)


class Slots:
    """Where the pieces of a length go: runs of consecutive ranks to runs of consecutive sequences, at one offset."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        taken, rows, base = Counter(), [], 0
        for p, n in plan:
            at = 0
            for v in p:
                rows.append((v, taken[v], base, at))
                taken[v] += n
                at += v
            base += n
        rows.sort()
        self.sequences = base
        length, first, self.base, self.at = np.array(rows, dtype=np.int64).reshape(-1, 4).T
        self.first = first
        self.key = (length << 48) + first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        i = np.searchsorted(self.key, (length.astype(np.int64) << 48) + rank, side="right") - 1
        return self.base[i] + rank - self.first[i], self.at[i]


def histogram(rows: DataFrame, length: int = LENGTH) -> np.ndarray:
    """Pieces by length, from 0 to length."""
    counts = np.zeros(length + 1, dtype=np.int64)
    for r in rows.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return counts


def placed(rows: DataFrame, slots: Slots) -> DataFrame:
    """rows (length, part, rank, ...) with sequence_id and offset instead of part and rank."""
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("_n"))
    bases = counts.select("length", "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s, at = slots.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": s, "offset": at})

    keep = [c for c in rows.columns if c not in ("part", "rank")]
    numbered = rows.join(bases, ["length", "part"]).select(*keep, slot("length", F.col("_base") + F.col("rank")).alias("_slot"))
    return numbered.select(*keep, "_slot.*")


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id and offset of every piece of docs (doc_id, text)."""
    rows = pieces(docs, tokenizer, length)
    return placed(rows, Slots(plan(histogram(rows, length))))


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and doc_ids and lengths of its pieces in order, a row a sequence. A group is one sequence."""
    held = F.array_sort(F.collect_list(F.struct("offset", "length", "doc_id", "ids")))
    s = packed.groupBy("sequence_id").agg(held.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    return s.select("sequence_id", ids.alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every whole text of documents; the ids' checksums are of the ids that were written."""
    rows = pieces(docs_table(spark, sf_dir), default_tokenizer())
    slots = Slots(plan(histogram(rows)))
    digest = rows.select("doc_id", "piece", "start", F.col("length"), F.crc32("ids").alias("ids_crc32"), "part", "rank")
    return placed(digest, slots).withColumn("length", F.col("length").cast("long"))
