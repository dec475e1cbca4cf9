"""Self-join of documents by the Jaccard similarity of their word n-grams, by chosen paths.

A document's set holds the hashes of its runs of five words (`[^\\x20\\x09-\\x0D]+`, unchanged); one of fewer words, but
not none, has one element, the run of all. Documents of equal sets form a class; all further work is on classes.

Each class gets a sketch: one-permutation minimum hashes in 512 bins, empty bins filled from others. A run of the join
picks sketch positions, each with a chance that makes 1 / similarity picks on average, and puts the class in a bucket
for each pick and its value. Buckets of more than a few classes are split again in the same way, on positions picked
anew for each bucket, to a depth that grows with the logarithm of the documents; small ones are compared by brute force:
sizes, then the estimate from one bit of each position. Runs are repeated until a pair at the least similarity is met
with the target recall, counted at the deepest level.

A group of very many near copies stays together however often its bucket is split. So the largest buckets are first cut
into chunks and what is near within a chunk is put in one group; as a class is in many buckets, chunks join up. Pairs
inside a group need no further search, and a bucket of one group only is done. What the last level leaves large is cut
into chunks of the group of its smallest class and of others, and each two chunks that aren't both of that group are
compared, so nothing is dropped. A task sends the links of a forest, not pairs. Classes that these hold together are a
family; in it all pairs are proven on the whole sets and counted where the sets are. Large families are cut into chunks.

Null and empty texts have no set, link with nothing and are all kept. Repeated rows are rows of one class; of rows alike
in id and text keep_first() keeps one. A null id stays null and counts as the largest; rows that share an id or have
none are told apart by their texts. An empty table gives no rows. Extra columns are kept by keep_first(), whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Texts, as_bytes, docs_table, materialize, mix, release, small_batches, windows
from .components import Forest, components, forest

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.9995
BINS, SPLIT_BINS = 512, 128
#: Classes in a bucket that is compared by brute force; in one that is cut into chunks; of a chunk in which groups are looked for.
SMALL, LARGE, CHUNK = 64, 256, 512
#: Classes of a family, and their elements, proven together; a larger family is cut and each two parts are proven.
PROOF, PROOF_WORDS = 1024, 1 << 19

_rng = np.random.default_rng(20240607)
_FILL = _rng.integers(0, BINS, (BINS, 32))
_BIT = _rng.integers(1, 1 << 63, BINS, dtype=np.uint64)


def levels(documents: int) -> int:
    """Levels of splitting: three, and one more for each hundredfold of a million documents."""
    return 3 + max(0, math.ceil(math.log(max(1, documents) / 1e6, 100)))


def runs(recall: float, depth: int) -> int:
    """Runs until a pair at the least similarity is met with the recall, where each level keeps it with the chance of a branching process of mean 1."""
    kept = 1.0
    for _ in range(depth):
        kept = 1 - math.exp(-kept)
    return math.ceil(math.log(1 - recall) / math.log(1 - kept))


def picks(similarity: float, recall: float, depth: int) -> list[tuple[int, int]]:
    """(run, position) of the first level; the same for all classes."""
    rng = np.random.default_rng(97)
    return [(r, int(p)) for r in range(runs(recall, depth)) for p in np.flatnonzero(rng.random(BINS) < 1 / (similarity * BINS))]


def shingle_sets(texts: list[bytes], n: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its n-grams, mixed."""
    t = Texts(texts)
    whole = mix(t.runs(n))
    out = []
    for a, b in zip(t.starts.tolist(), t.ends.tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(whole[a : b - n + 1]))
        else:
            out.append(mix(windows(t.hashes[a:b], b - a)) if b > a else np.empty(0, dtype=np.uint64))
    return out


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def sketch(found: np.ndarray) -> np.ndarray:
    """Minimum of each bin (the high bits) of sorted hashes; empty bins take another's."""
    bins = (found >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    own = bins[first]
    out = np.zeros(BINS, dtype=np.uint64)
    out[own] = found[first]
    if len(own) < BINS:
        full = np.zeros(BINS, dtype=bool)
        full[own] = True
        empty = np.flatnonzero(~full)
        got = full[_FILL[empty]]
        take = _FILL[empty, got.argmax(axis=1)]
        none = ~got.any(axis=1)
        if none.any():
            take[none] = own[np.searchsorted(own, empty[none]) % len(own)]
        out[empty] = out[take]
    return out


def features(docs: DataFrame, similarity: float, recall: float, depth: int) -> DataFrame:
    """doc_id, k (hash of id and text), d (class), n (set size), bits, parts (16 bits of some positions) and keys (buckets of the first level); d is null without words."""
    chosen = picks(similarity, recall, depth)
    place = np.array([p for _, p in chosen])
    salt = mix(np.arange(1, len(chosen) + 1, dtype=np.uint64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                rows = []
                for found in shingle_sets(as_bytes(pa.chunked_array([part["text"]]))):
                    if len(found):
                        s = sketch(found)
                        bits = np.packbits((mix(s ^ _BIT) & np.uint64(1)).astype(bool)).tobytes()
                        rows.append((digest(found), len(found), bits, (s[:SPLIT_BINS] & np.uint64(0xFFFF)).astype("<u2").tobytes(), mix(s[place] ^ salt).view(np.int64)))
                    else:
                        rows.append((None, 0, None, None, None))
                d, n, bits, parts, keys = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["k"], pa.array(d, pa.binary()), pa.array(n, pa.int32()), pa.array(bits, pa.binary()), pa.array(parts, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "k", "d", "n", "bits", "parts", "keys"],
                )

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), row_key(), "text")
    return rows.mapInArrow(run, "doc_id long, k long, d binary, n int, bits binary, parts binary, keys array<long>")


def row_key():
    """k: what tells rows apart, alike only for rows alike in id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("k")


def _counted(rows: DataFrame) -> DataFrame:
    """Rows (key, c, and g if classes are in groups) of buckets with two classes at least, of two groups at least, with the bucket's size: one sum and one join for both."""
    g = "g" if "g" in rows.columns else "c"
    sizes = rows.groupBy("key").agg(F.count("*").alias("size"), F.min(g).alias("_l"), F.max(g).alias("_h")).where("_l < _h").drop("_l", "_h")
    return rows.join(sizes, "key")


def _split(rows: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Each class of a large bucket to buckets for positions picked anew for that bucket."""
    chance = np.uint64(int(2**64 / (similarity * SPLIT_BINS)))
    places = mix(np.arange(1, SPLIT_BINS + 1, dtype=np.uint64))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            key = b["key"].to_numpy(zero_copy_only=False).view(np.uint64)
            parts = np.frombuffer(b"".join(b["parts"].to_pylist()), dtype="<u2").reshape(-1, SPLIT_BINS).astype(np.uint64)
            for i in range(0, len(key), 2000):
                own = mix(key[i : i + 2000, None] ^ places)
                row, at = np.nonzero(own < chance)
                new = mix(own[row, at] + parts[i + row, at])
                at = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), b["c"].take(at), b["g"].take(at)], ["key", "c", "g"])

    return rows.select("key", "c", "g").join(classes.select("c", "parts"), "c").mapInArrow(run, "key long, c long, g long").distinct()


def _dealt(rows: DataFrame, classes: DataFrame, bucket, *more: str) -> DataFrame:
    """rows (c and what bucket needs) with n and bits, each bucket whole in one task and sorted; buckets are of some hundreds of classes at most."""
    n = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    out = rows.join(classes.select("c", "n", "bits"), "c").withColumn("bucket", bucket).select("bucket", *more, "c", "n", "bits")
    return out.repartition(n, "bucket").sortWithinPartitions("bucket")


def groups(rows: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """a, b: near classes found within chunks of the largest buckets (key, c, size), each linked to its group's smallest."""
    chunk = F.pmod(F.xxhash64("key", "c"), F.ceil(F.col("size") / CHUNK))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for t in grouped(it, "bucket"):
            f.add(pivoted(t, similarity))
        yield from f.sent()

    return components(_dealt(rows, classes, F.xxhash64("key", chunk)).mapInArrow(run, "a long, b long"))


def pivoted(t: pa.Table, similarity: float) -> Iterator[tuple[int, int]]:
    """Links of estimates not below the similarity in each bucket of a table: each class reached is compared with those not yet reached."""
    bucket, ids, n = (t[c].to_numpy() for c in ("bucket", "c", "n"))
    bits = np.frombuffer(b"".join(t["bits"].to_pylist()), dtype=np.uint64).reshape(-1, BINS // 64)
    cut = np.append(np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1)), len(bucket))
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        left = np.arange(i, j)
        while len(left) > 1:
            todo, left = [int(left[0])], left[1:]
            while todo and len(left):
                v = todo.pop()
                near = (np.minimum(n[left], n[v]) >= similarity * np.maximum(n[left], n[v])) & (1 - 2 * np.bitwise_count(bits[left] ^ bits[v]).sum(axis=1) / BINS >= similarity)
                hit = left[near].tolist()
                todo += hit
                left = left[~near]
                yield from ((int(ids[v]), int(ids[w])) for w in hit)


def leaves(classes: DataFrame, similarity: float, depth: int) -> tuple[DataFrame, DataFrame | None]:
    """The buckets to compare by brute force: key, c, part, low, high (where low isn't high, only classes of different parts are compared); and the links of groups, if any were looked for."""
    rows = materialize(_counted(classes.select(F.explode("keys").alias("key"), "c")), "level1")
    tables, found = [rows], None
    out = rows.where(F.col("size") <= SMALL).select("key", "c")
    large = rows.where(F.col("size") > SMALL)
    if large.isEmpty():
        return _chunks(out), None
    widest = large.where(F.col("size") > LARGE)
    if widest.isEmpty():
        large = large.withColumn("g", F.col("c"))
    else:
        found = groups(widest, classes, similarity)
        own = found.select(F.col("a").alias("c"), F.col("b").alias("_g"))
        large = _counted(large.select("key", "c").join(own, "c", "left").select("key", "c", F.coalesce("_g", "c").alias("g")))
    rest = None
    for level in range(2, depth + 1):
        rows = materialize(_counted(_split(large, classes, similarity)), f"level{level}")
        tables.append(rows)
        out = out.unionByName(rows.where(F.col("size") <= (LARGE if level == depth else SMALL)).select("key", "c"))
        large = rows.where(F.col("size") > SMALL)
        rest = rows.where(F.col("size") > LARGE)
    made = materialize(_chunks(out, rest), "leaves")
    release(*tables)
    return made, found


def _chunks(whole: DataFrame, rest: DataFrame | None = None) -> DataFrame:
    """key, c, part, low, high: whole buckets, and chunks of the rest: those of the group of a bucket's smallest class meet all others', and these each other's."""
    zero = F.lit(0)
    out = whole.select("key", "c", zero.alias("part"), zero.alias("low"), zero.alias("high"))
    if rest is None:
        return out
    main = rest.groupBy("key").agg(F.min(F.struct("c", "g"))["g"].alias("main"), F.count("*").alias("size"))
    sizes = rest.join(main.select("key", "main"), "key").groupBy("key", "main").agg(F.count_if(F.col("g") == F.col("main")).alias("same"), F.count_if(F.col("g") != F.col("main")).alias("others"))
    others = F.ceil(F.col("others") / LARGE).cast("int")
    same = F.ceil(F.col("same") / LARGE).cast("int")
    r = rest.select("key", "c", "g").join(sizes, "key").withColumn("is_main", F.col("g") == F.col("main"))
    # others are numbered from 0, the main group from there on
    r = r.withColumn("part", F.when(F.col("is_main"), others + F.pmod(F.xxhash64("c"), same)).otherwise(F.pmod(F.xxhash64("c"), others)).cast("int"))
    last = F.when(F.col("is_main"), others - 1).otherwise(others + same - 1)
    r = r.withColumn("o", F.explode(F.sequence(zero, last)))
    return out.unionByName(r.select("key", "c", "part", F.least("part", "o").alias("low"), F.greatest("part", "o").alias("high")))


def near(classes: DataFrame, similarity: float, depth: int) -> DataFrame:
    """a, b: links that hold together the classes whose estimate isn't below the least similarity by four standard deviations; for each task a forest, not all pairs."""
    rows, found = leaves(classes, similarity, depth)
    dealt = _dealt(rows.withColumn("cross", F.col("low") != F.col("high")), classes, F.xxhash64("key", "low", "high"), "cross", "part")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for t in grouped(it, "bucket"):
            f.add(compare(t, similarity))
        yield from f.sent()

    out = dealt.mapInArrow(run, "a long, b long")
    return out if found is None else out.unionByName(found)


def grouped(it: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by key."""
    held: list[pa.Table] = []
    for b in it:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        last = t[key][-1]
        if held and last == held[-1][key][-1] and t[key][0] == last:
            held.append(t)
            continue
        cut = int(np.flatnonzero(t[key].to_numpy() == last.as_py())[0])
        yield_now = pa.concat_tables([*held, t.slice(0, cut)])
        if yield_now.num_rows:
            yield yield_now.combine_chunks()
        held = [t.slice(cut)]
    if held:
        yield pa.concat_tables(held).combine_chunks()


def compare(t: pa.Table, similarity: float) -> Iterator[tuple[int, int]]:
    """Brute force in each bucket of a table sorted by bucket: rows i and i + k, for k = 1, 2, ... while any bucket is that long."""
    bucket, part, n = (t[c].to_numpy() for c in ("bucket", "part", "n"))
    cross = t["cross"].to_numpy(zero_copy_only=False).astype(bool)
    ids = t["c"].to_pylist()
    bits = np.frombuffer(b"".join(t["bits"].to_pylist()), dtype=np.uint64).reshape(-1, BINS // 64)
    effective = BINS * (1 - np.exp(-n / BINS))
    at = np.arange(len(bucket))
    for k in range(1, len(bucket)):
        at = at[at < len(bucket) - k]
        at = at[bucket[at] == bucket[at + k]]
        if not len(at):
            break
        i = at[~cross[at] | (part[at] != part[at + k])]
        j = i + k
        fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
        i, j = i[fits], j[fits]
        apart = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1)
        close = 1 - 2 * apart / BINS >= similarity - 4 * 0.6 / np.sqrt(np.minimum(effective[i], effective[j]))
        for x, y in zip(i[close].tolist(), j[close].tolist(), strict=True):
            yield ids[x], ids[y]


def texts(docs: DataFrame) -> DataFrame:
    """k and text, once for all rows alike in id and text: these are made one where they are read, before any shuffle."""
    return docs.select(row_key(), F.col("text").cast("binary").alias("text")).groupBy("k").agg(F.min("text").alias("text"))


def proven(families: DataFrame, classes: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """a, b, links: for each class a its links to others by whole sets, in parts to be summed, and a link to b that holds a family's linked classes together (null where it is the smallest).

    families: a (class) and b (its family). classes: c, d, n, m (documents), k (the row of one of its documents). All
    pairs of a family are compared where its sets are; they are counted, not sent.
    """
    members = families.union(families.select("b", "b").distinct()).toDF("c", "family").join(classes.select("c", "d", "n", "m", "k"), "c")
    sizes = members.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / PROOF), F.ceil(F.sum("n") / PROOF_WORDS)).cast("int").alias("parts"))
    members = members.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    members = members.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("c", "d", "m", "k", "part", F.xxhash64("family", F.least("part", "o"), F.greatest("part", "o")).alias("g"), (F.col("part") != F.col("o")).alias("cross"))
    rows = members.join(texts(docs), "k").select("g", "cross", "part", "c", "d", "m", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, rows = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if len(rows) > 1:
                yield from prove(rows, similarity)

        for b in it:
            sets = shingle_sets(as_bytes(pa.chunked_array([b["text"]])))
            for g, cross, part, c, d, m, found in zip(*(b[x].to_pylist() for x in ("g", "cross", "part", "c", "d", "m")), sets, strict=True):
                if g != group:
                    yield from done()
                    group, rows = g, {}
                if c not in rows and digest(found) == d:
                    rows[c] = (found, m, part if cross else None)
        yield from done()

    return rows.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "a long, b long, links long")


def prove(rows: dict[int, tuple], similarity: float) -> Iterator[pa.RecordBatch]:
    """All pairs of some sets: how many elements they share by products of blocks of their incidence matrix."""
    ids = sorted(rows)
    sets = [rows[d][0] for d in ids]
    sizes = np.array([len(x) for x in sets])
    m = np.array([rows[d][1] for d in ids], dtype=np.int64)
    owner = np.repeat(np.arange(len(ids)), sizes)
    _, element, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[element] > 1
    owner, element = owner[shared], (np.cumsum(count > 1) - 1)[element[shared]]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    common = np.zeros((len(ids), len(ids)), dtype=np.float32)
    width = 2048
    total = int(element[-1]) + 1 if len(element) else 0
    cuts = np.searchsorted(element, np.arange(0, total + width, width))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        block = np.zeros((len(ids), min(width, total - k * width)), dtype=np.float32)
        block[owner[i:j], element[i:j] - k * width] = 1
        common += block @ block.T
    common = np.rint(common).astype(np.int64)
    linked = common >= similarity * (sizes[:, None] + sizes[None, :] - common)
    np.fill_diagonal(linked, False)
    part = [rows[d][2] for d in ids]
    if part[0] is not None:
        part = np.array(part)
        linked &= part[:, None] != part[None, :]
    links = linked @ m
    i, j = np.nonzero(np.triu(linked))
    roots = dict(forest(zip(i.tolist(), j.tolist(), strict=True)))
    at = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in at], pa.int64()), pa.array([ids[roots[x]] if x in roots else None for x in at.tolist()], pa.int64()), pa.array(links[at])], ["a", "b", "links"])


def joined(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row for each document: doc_id, k, class_id (smallest doc_id of equal sets), component_id (smallest reached by links), n_links, kept; d is null without words."""
    depth = levels(docs.count())
    found = materialize(features(docs, similarity, recall, depth), "features")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    per = found.where("d is not null").groupBy("d").agg(F.min(first).alias("first"), F.count("*").alias("m"), F.first(F.struct("n", "bits", "parts", "keys")).alias("x"))
    classes = materialize(per.select("d", "first", "first.k", "m", "x.*").withColumn("c", F.monotonically_increasing_id()), "classes")
    families = components(near(classes, similarity, depth))
    links = materialize(proven(families, classes, docs, similarity), "links")
    roots = components(links.where("b is not null")).select(F.col("a").alias("c"), F.col("b").alias("root"))
    of = classes.select("c", "d", "first", "m").join(links.groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("near")), "c", "left")
    of = materialize(of.join(roots, "c", "left").withColumn("root", F.coalesce("root", "c")), "of")
    least = materialize(of.groupBy("root").agg(F.min("first").alias("least")), "least")
    of = materialize(of.join(least, "root").select("d", F.col("first.doc_id").alias("class_id"), "least", (F.col("m") - 1 + F.coalesce("near", F.lit(0))).alias("n_links")), "classified")
    out = found.select("doc_id", "k", "d").join(of, "d", "left")
    release(families, links)
    alone = F.col("least").isNull()
    return out.select(
        "doc_id", "k", "d", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), (alone | (F.col("least.k") == F.col("k"))).alias("kept"),
    )


def jaccard_join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row for each document: doc_id, class_id, component_id, n_links, kept (that of its component's smallest id; rows alike in id and text alike)."""
    return joined(docs, similarity, recall).select("doc_id", "class_id", "component_id", "n_links", "kept")


def keep_first(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """docs with one document of each group that links hold together: that of the smallest id, and of rows that repeat it one. All columns as they were; rows without words stay."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_key(), F.coalesce(F.col("text").rlike(WORD), F.lit(False)).alias("_words"))
    kept = joined(docs, similarity, recall).where("kept and d is not null").select("k").distinct()
    one = own.where("_words").groupBy("k").agg(F.first("row").alias("row"))  # of rows that repeat it, added up where they are read
    return one.join(kept, "k").select("row").unionByName(own.where("not _words").select("row")).select("row.*")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The join of all documents with themselves."""
    return jaccard_join(docs_table(spark, sf_dir))
