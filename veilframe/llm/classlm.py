"""Scores of texts by a Brown class-based bigram model: log10 P(text) = sum of log10 P(class | class before) P(word | class).

Words are lower-cased (A-Z) runs of `[^\\x20\\x09-\\x0D]+`; an end follows each text, and stands before its first word.

Every word of the training texts is counted and assigned by its own bigrams. Exchange clustering begins with items of a
fixed number: the most frequent words, and for all others their endings (the last bytes, hashed); it moves items between
classes while that raises the likelihood of the class bigrams. Then each other word of the training texts leaves its
ending: the classes beside it are counted over all texts, and it takes the class in which they are likeliest, the others
staying where exchange left them (a batch step of exchange, in parallel over words). A word never seen has the class of
its ending. Class bigrams are counted anew from the classes of all words. A class transition is smoothed towards the
class frequencies (Witten-Bell), a word's emission is discounted, and what that frees goes to as many unseen words as
the class has seen ones; where more than these occur in texts that weren't learned from, their probabilities pass 1 together.

Documents are dealt to blocks of a bounded size. A block sends each of its distinct words once, as a 64-bit hash with
its count in training texts; sums are added up before the shuffle, and go back to the blocks by a join whose large
partitions Spark splits. The bigrams of frequent words, a bounded number, are summed by class in the tasks that count
them and again after a shuffle, so that no task holds what all texts say of one word.

A null text is empty: one token, its end. Rows with a null id are scored but not learned from. Repeated rows count and
are scored each. Without training texts nothing is known: base scores divide by the one unknown type, and the model's
score is that of one unknown class. Extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Texts, as_bytes, batches, dealt, docs_table, fold_of, hashed_ranges, materialize, release, small_batches

#: Words that are items of their own, items for endings, characters of an ending, classes, sweeps of the exchange.
TOP, ENDINGS, ENDING, CLASSES, SWEEPS = 1500, 512, 3, 64, 8
BLOCK_BYTES, LEAST_BLOCKS = 8 << 20, 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class Tokens:
    """The words of some texts in a row with an end after each: distinct words and their places."""

    def __init__(self, texts: list[bytes]):
        t = Texts([x.translate(LOWER) for x in texts])
        self.lengths = t.lengths + 1
        self.ends = np.cumsum(self.lengths)
        at = np.ones(int(self.lengths.sum()), dtype=bool)
        at[self.ends - 1] = False
        codes, self.hashes = pd.factorize(t.hashes)
        first = np.empty(len(self.hashes), dtype=np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        self.raw, self.begin, self.stop = t.raw, t.begin[first], t.stop[first]
        #: Number of the distinct word, or their count for an end.
        self.number = np.full(len(at), len(self.hashes), dtype=np.int64)
        self.number[at] = codes

    def endings(self) -> np.ndarray:
        """Of each distinct word a number below ENDINGS from its last characters."""
        a = np.frombuffer(self.raw, dtype=np.uint8)
        chars = np.flatnonzero((a & 0xC0) != 0x80)  # UTF-8: a byte that goes on begins with 10
        from_char = np.maximum(np.searchsorted(chars, self.stop) - ENDING, 0)
        from_byte = np.maximum(chars[from_char], self.begin) if len(chars) else self.begin
        return (hashed_ranges(a, self.raw, from_byte, self.stop) % np.uint64(ENDINGS)).astype(np.int64)

    def per_text(self, x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(x)])
        return total[self.ends] - total[self.ends - self.lengths]


class Items:
    """Word to item: 0 is the end, then the top words by hash, then endings."""

    def __init__(self, top: np.ndarray):
        self.top = np.sort(top.astype(np.uint64))
        self.size = 1 + len(top) + ENDINGS

    def of(self, t: Tokens) -> np.ndarray:
        """The item of each distinct word, and of the end."""
        out = 1 + len(self.top) + t.endings()
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, t.hashes), len(self.top) - 1)
            out = np.where(self.top[at] == t.hashes, 1 + at, out)
        return np.append(out, 0)


def plogp(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each item by exchange clustering of a bigram count matrix; item 0, the end, has class 0 for itself."""
    c = counts.astype(np.float64)
    n = len(c)
    weight = c.sum(axis=0) + c.sum(axis=1)
    order = [i for i in np.argsort(-weight, kind="stable").tolist() if i]
    cls = np.zeros(n, dtype=np.int64)
    for k, i in enumerate(order):
        cls[i] = 1 + k % (classes - 1)
    one = np.eye(classes)[cls]
    to, by = c @ one, one.T @ c  # item to class, class to item
    table = one.T @ to

    for _ in range(sweeps):
        moved = 0
        for i in order:
            if not weight[i]:
                continue
            a, own = cls[i], c[i, i]
            row, col = to[i].copy(), by[:, i].copy()
            # without i
            row[a] -= own
            col[a] -= own
            base = table.copy()
            base[a] -= row
            base[:, a] -= col
            base[a, a] -= own
            # totals with i's bigrams counted, but not yet as a class's own
            left, right = base.sum(axis=1) + col, base.sum(axis=0) + row
            out, into = row.sum() + own, col.sum() + own
            # gain of adding i to each class: its row, its column, their crossing, and the class totals
            f = plogp(base)
            gain = (plogp(base + row) - f).sum(axis=1) + (plogp(base + col[:, None]) - f).sum(axis=0)
            d = np.diag(base)
            gain += plogp(d + row + col + own) - plogp(d + row) - plogp(d + col) + plogp(d)
            gain -= plogp(left + out) - plogp(left) + plogp(right + into) - plogp(right)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if b != a and gain[b] > gain[a] + 1e-6:
                moved += 1
                base[b] += row
                base[:, b] += col
                base[b, b] += own
                table = base
                to[:, a] -= c[:, i]
                to[:, b] += c[:, i]
                by[a] -= c[i]
                by[b] += c[i]
                cls[i] = b
        if not moved:
            break
    return cls


def transitions(table: np.ndarray) -> np.ndarray:
    """log10 of the class transitions: bigram counts smoothed towards the class frequencies."""
    table = table.astype(np.float64)
    total = table.sum(axis=0)
    unigram = (total + 1) / (total.sum() + len(table))
    spread = np.maximum((table > 0).sum(axis=1), 1)[:, None]
    return np.log10((table + spread * unigram) / (table.sum(axis=1)[:, None] + spread))


def discounts(ones: np.ndarray, twos: np.ndarray) -> np.ndarray:
    """What each class takes from the count of a word seen, for as many words not seen; the end's class, 0, frees nothing."""
    out = np.clip(ones / np.maximum(ones + 2 * twos, 1), 0.05, 0.95)
    out[0] = 0.0
    return out


def emissions(counts: np.ndarray, cls: np.ndarray, total: np.ndarray, discount: np.ndarray) -> np.ndarray:
    """The probability of words of some counts in their classes: a class's seen words and as many unseen ones make 1; one unseen word does in a class without words."""
    return np.where(counts > 0, counts - discount[cls], np.where(total[cls] > 0, discount[cls], 1.0)) / np.maximum(total[cls], 1)


class Words:
    """Classes of the items, and what emissions and base scores need: count and discount of each class."""

    def __init__(self, items: Items, classes: np.ndarray, total: np.ndarray, discount: np.ndarray, tokens: int, vocabulary: int, ends: int):
        self.items, self.classes, self.total, self.discount = items, classes, total, discount
        self.tokens, self.vocabulary, self.ends = tokens, vocabulary, ends

    def emit(self, t: Tokens, counts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, base score and emissions; and the class of each token. counts, own: of the distinct words, in training texts, and their own class or -1."""
        cls = np.where(np.append(own, -1) >= 0, np.append(own, -1), self.classes[self.items.of(t)])
        c = np.append(counts, self.ends)
        base = np.log10((c + 1) / (self.tokens + self.vocabulary + 1))
        emission = np.log10(np.where((c > 0) | (cls > 0), emissions(c, cls, self.total, self.discount), 1.0))
        return t.per_text((c > 0)[t.number].astype(np.int64)), t.per_text(base[t.number]), t.per_text(emission[t.number]), cls[t.number]


LEXICON = "block int, h long, ending int, n long"


def lexicon(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """block, h, ending, n: the distinct words of each block with their counts in its training texts; and h, ending, c: those of all training texts."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        tokens = Tokens(as_bytes(t["text"]))
        train = np.repeat(t["train"].to_numpy(zero_copy_only=False).astype(np.int64), tokens.lengths)
        n = np.bincount(tokens.number, weights=train, minlength=len(tokens.hashes) + 1)[:-1].astype(np.int64)
        return pa.table({"block": pa.array(np.full(len(n), key[0].as_py(), dtype=np.int32)), "h": pa.array(tokens.hashes.view(np.int64)), "ending": pa.array(tokens.endings().astype(np.int32)), "n": pa.array(n)})

    words = materialize(rows.groupBy("block").applyInArrow(run, LEXICON), "lexicon")
    types = words.where("n > 0").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("c"))
    return words, materialize(types, "types")


def item_bigrams(train: DataFrame, items: Items) -> np.ndarray:
    """The matrix of item bigram counts over all training texts: tasks' matrices are summed row by row, and the sum, of bounded size, comes here."""
    size = items.size
    shared = train.sparkSession.sparkContext.broadcast(items)

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, total = shared.value, np.zeros(size * size, dtype=np.int64)
        for b in batches(it, 8 << 20):
            t = Tokens(as_bytes(b["text"]))
            seq = np.concatenate([[0], items.of(t)[t.number]])  # an end stands before the first text and after each
            total += np.bincount(seq[:-1] * size + seq[1:], minlength=size * size)
        z = zstandard.ZstdCompressor(level=1)
        at = np.flatnonzero(total.reshape(size, size).any(axis=1))
        for i in range(0, len(at), 256):
            part = at[i : i + 256]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([z.compress(total[r * size : (r + 1) * size].tobytes()) for r in part.tolist()], pa.binary())], ["item", "counts"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, row = zstandard.ZstdDecompressor(), np.zeros(size, dtype=np.int64)
        for b in parts:
            for x in b["counts"].to_pylist():
                row += np.frombuffer(z.decompress(x), dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(row.tobytes())], pa.binary())], ["item", "counts"])

    out = np.zeros((size, size), dtype=np.int64)
    z = zstandard.ZstdDecompressor()
    kind = "item int, counts binary"
    for r in train.select("text").mapInArrow(count, kind).groupBy("item").applyInArrow(add, kind).toLocalIterator():
        out[r["item"]] = np.frombuffer(z.decompress(bytes(r["counts"])), dtype=np.int64)
    return out


NEAR = "h long, seed int, near array<long>"
COUNT = 40  # bits of a count beside a class
#: Words that more than one in so many tokens is: no more than so many, whatever the corpus.
HOT = 1 << 20


def neighbours(train: DataFrame, items: Items, classes: np.ndarray, hot: np.ndarray) -> DataFrame:
    """h, seed, near: each word that isn't an item of its own with its ending's class and the classes beside it in some texts: longs of (side * CLASSES + class) << COUNT | count.

    A hot word (hot: their hashes) has a row for each class beside it in all texts, 2 * CLASSES at most, as sums begin in
    the tasks that count; any other has a row for each batch of texts that holds it, so no more than one in HOT tokens.
    """
    shared = train.sparkSession.sparkContext.broadcast((items, classes, np.sort(hot.astype(np.uint64))))  # HOT hashes at most

    def counted(it: Iterator[pa.RecordBatch], of_hot: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For batches of texts: hashes and seeds of the distinct words, and word, class beside it and count of their bigrams."""
        items, classes, hot = shared.value
        for b in batches(it, 8 << 20):
            t = Tokens(as_bytes(b["text"]))
            item = items.of(t)
            now = classes[item][t.number]
            wanted = np.zeros(len(t.hashes), dtype=bool)
            if len(hot):
                wanted = hot[np.minimum(np.searchsorted(hot, t.hashes), len(hot) - 1)] == t.hashes
            wanted = np.append(wanted == of_hot, False) & (item > len(items.top))
            at = np.flatnonzero(wanted[t.number])
            word = t.number[at] * (2 * CLASSES)
            before, after = np.append(0, now[:-1])[at], now[np.minimum(at + 1, len(now) - 1)]  # an end follows each text
            key, n = np.unique(np.concatenate([word + before, word + CLASSES + after]), return_counts=True)
            yield t.hashes, classes[item], key // (2 * CLASSES), key % (2 * CLASSES), n

    def rare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, seed, word, beside, n in counted(it, False):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            near = pa.ListArray.from_arrays(pa.array(np.append(first, len(word)).astype(np.int32)), pa.array(beside << COUNT | n))
            yield pa.RecordBatch.from_arrays([pa.array(hashes[word[first]].view(np.int64)), pa.array(seed[word[first]].astype(np.int32)), near], ["h", "seed", "near"])

    def often(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, seed, word, beside, n in counted(it, True):
            yield pa.RecordBatch.from_arrays([pa.array(hashes[word].view(np.int64)), pa.array(seed[word].astype(np.int32)), pa.array(beside), pa.array(n)], ["h", "seed", "beside", "n"])

    texts = train.select("text")
    sums = texts.mapInArrow(often, "h long, seed int, beside long, n long").groupBy("h", "seed", "beside").agg(F.sum("n").alias("n"))
    entry = F.shiftleft("beside", COUNT).bitwiseOR(F.col("n"))
    return texts.mapInArrow(rare, NEAR).unionByName(sums.select("h", "seed", F.array(entry).alias("near")))


def likeliest(table: np.ndarray, key: np.ndarray, n: np.ndarray, first: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The class of each word by its bigrams: key and n of each class beside it, sorted by words, which begin at first; seed: the class that the table counts it in."""
    cells = np.concatenate([table, table.T])  # by what stands before a word, then by what stands after it
    size = np.diff(np.append(first, len(key)))
    own = np.repeat(seed, size)
    x = cells[key]
    gain = plogp(x + n[:, None]) - plogp(x)
    at = np.arange(len(key))
    gain[at, own] = plogp(x[at, own]) - plogp(np.maximum(x[at, own] - n, 0))
    gain = np.add.reduceat(gain, first, axis=0)
    count = np.add.reduceat(np.where(key < len(table), n, 0), first)
    word = np.arange(len(first))
    for total in (table.sum(axis=0), table.sum(axis=1)):
        loss = plogp(total + count[:, None]) - plogp(total)
        loss[word, seed] = plogp(total[seed]) - plogp(np.maximum(total[seed] - count, 0))
        gain -= loss
    # not the end's class, and none without items: words that move at once would all meet there
    gain[:, (table.sum(axis=0) == 0) | (np.arange(len(table)) == 0)] = -np.inf
    best = np.argmax(gain, axis=1)
    return np.where(gain[word, best] > gain[word, seed] + 1e-6, best, seed)


def placed(near: DataFrame, table: np.ndarray, parts: int) -> DataFrame:
    """h, cls: the class of every word of near() by all its bigrams, given the class bigrams of exchange."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def added(h: np.ndarray, seed: np.ndarray, entry: np.ndarray) -> list[np.ndarray]:
            """The same words, sorted, with one entry for each class beside them."""
            word = np.cumsum(np.diff(h, prepend=h[0]) != 0)
            at, first, inverse = np.unique(word * (2 * CLASSES) + (entry >> COUNT), return_index=True, return_inverse=True)
            n = np.bincount(inverse, weights=entry & ((1 << COUNT) - 1)).astype(np.int64)
            return [h[first], seed[first], at % (2 * CLASSES) << COUNT | n]

        def solved(h: np.ndarray, seed: np.ndarray, entry: np.ndarray) -> pa.RecordBatch:
            begin = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            cls = likeliest(table, entry >> COUNT, (entry & ((1 << COUNT) - 1)).astype(np.float64), begin, seed[begin])
            return pa.RecordBatch.from_arrays([pa.array(h[begin]), pa.array(cls.astype(np.int32))], ["h", "cls"])

        held = [np.empty(0, dtype=np.int64)] * 3
        for b in it:
            if not b.num_rows:
                continue
            size = pc.list_value_length(b["near"]).to_numpy(zero_copy_only=False)
            new = [np.repeat(b["h"].to_numpy(), size), np.repeat(b["seed"].to_numpy().astype(np.int64), size), b["near"].flatten().to_numpy()]
            held = added(*[np.concatenate(x) for x in zip(held, new, strict=True)])
            cut = int(np.searchsorted(held[0], held[0][-1]))  # the last word may go on: its sums are held, no more
            if cut:
                yield solved(*[x[:cut] for x in held])
                held = [x[cut:] for x in held]
        if len(held[0]):
            yield solved(*held)

    return near.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(run, "h long, cls int")


def fit(train: DataFrame, types: DataFrame, top: int = TOP, parts: int = LEAST_BLOCKS) -> tuple[Words, DataFrame]:
    """What scores need of train (text) and its lexicon's types; and h, c and cls of each type, cls null for items of their own."""
    whole = types.agg(F.count("*").alias("types"), F.sum("c").alias("n")).first()
    ends = train.count()
    found = types.orderBy(F.desc("c"), "h").limit(top).select("h", "c").collect()
    found = sorted((r["h"] & ((1 << 64) - 1), r["c"]) for r in found)
    items = Items(np.array([h for h, _ in found], dtype=np.uint64))
    bigrams = item_bigrams(train, items)
    classes = exchange(bigrams)
    one = np.eye(CLASSES)[classes]
    n = (whole["n"] or 0) + ends
    hot = np.array([r["h"] for r in types.where((F.col("c") > n / HOT) & (F.col("c") > 1)).select("h").toLocalIterator()], dtype=np.int64)
    others = placed(neighbours(train, items, classes, hot.view(np.uint64)), one.T @ bigrams @ one, parts)
    known = materialize(types.join(others, "h", "left").select("h", "c", "cls"), "classes")
    total, ones, twos = (np.zeros(CLASSES) for _ in range(3))
    for r in known.where("cls is not null").groupBy("cls").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect():
        total[r["cls"]], ones[r["cls"]], twos[r["cls"]] = r["c"], r["n1"], r["n2"]
    at, c = classes[: 1 + len(found)], np.array([ends, *[c for _, c in found]])
    np.add.at(total, at, c)
    np.add.at(ones, at[1:], c[1:] == 1)
    np.add.at(twos, at[1:], c[1:] == 2)
    return Words(items, classes, total, discounts(ones, twos), n, whole["types"] + (ends > 0), ends), known


def before(now: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Class before each token: that of the end before a text's first."""
    out = np.append(0, now[:-1])
    out[np.cumsum(lengths) - lengths] = 0
    return out


def class_bigrams(emitted: DataFrame) -> np.ndarray:
    """The matrix of class bigram counts over the classes of all training texts."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(CLASSES * CLASSES, dtype=np.int64)
        for b in it:
            if b.num_rows:
                now = np.frombuffer(b"".join(b["classes"].to_pylist()), dtype=np.uint8).astype(np.int64)
                out += np.bincount(before(now, b["n_tokens"].to_numpy()) * CLASSES + now, minlength=len(out))
        at = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(out[at])], ["pair", "n"])

    out = np.zeros(CLASSES * CLASSES, dtype=np.int64)
    pairs = emitted.where("train").select("n_tokens", "classes").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for r in pairs.collect():
        out[r["pair"]] = r["n"]
    return out.reshape(CLASSES, CLASSES)


EMITTED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, emission double, classes binary"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of docs (doc_id, text)."""
    rest = fold_of(F.col("doc_id"), 7)
    rows = dealt(small_batches(docs).select("doc_id", "text"), BLOCK_BYTES, LEAST_BLOCKS)
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"), F.coalesce(rest != 2, F.lit(False)).alias("train"), "block")
    words, types = lexicon(rows)
    model, known = fit(rows.where("train"), types, parts=max(LEAST_BLOCKS, words.rdd.getNumPartitions()))
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # a fixed number of items and classes

    def run(key: tuple, texts: pa.Table, known: pa.Table) -> pa.Table:
        t = Tokens(as_bytes(texts["text"]))
        h = known["h"].to_numpy().view(np.uint64)
        order = np.argsort(h, kind="stable")
        h = h[order]
        counts, own = np.zeros(len(t.hashes), dtype=np.int64), np.full(len(t.hashes), -1, dtype=np.int64)
        if len(h):
            at = np.minimum(np.searchsorted(h, t.hashes), len(h) - 1)
            same = h[at] == t.hashes
            counts = np.where(same, known["c"].to_numpy()[order][at], 0)
            own = np.where(same, pc.fill_null(known["cls"], -1).to_numpy()[order][at], -1)
        n_known, base, emission, now = shared.value.emit(t, counts, own)
        raw = pa.Array.from_buffers(pa.binary(), len(t.ends), [None, pa.py_buffer(np.append(0, t.ends).astype(np.int32).tobytes()), pa.py_buffer(now.astype(np.uint8).tobytes())])
        return pa.table({"doc_id": texts["doc_id"].cast(pa.int64()), "train": texts["train"], "n_tokens": pa.array(t.lengths), "n_known": pa.array(n_known), "base_score": pa.array(base), "emission": pa.array(emission), "classes": raw})

    back = words.select("block", "h").join(known, "h")
    got = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(run, EMITTED)
    emitted = materialize(got, "emitted")
    release(words, types, known)
    steps = context.broadcast(transitions(class_bigrams(emitted)))

    def finish(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                lengths = b["n_tokens"].to_numpy()
                now = np.frombuffer(b"".join(b["classes"].to_pylist()), dtype=np.uint8).astype(np.int64)
                moves = np.add.reduceat(steps.value[before(now, lengths), now], np.cumsum(lengths) - lengths)  # a text has its end at least
                yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_tokens"], b["n_known"], b["base_score"], pa.array(b["emission"].to_numpy() + moves)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = emitted.mapInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (F.coalesce(rest, F.lit(0)) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every whole text of documents."""
    return score(docs_table(spark, sf_dir))
