"""Near duplicates among embeddings by randomised-rotation binary codes.

Vectors are scaled to length 1 and turned by a random rotation; the signs are the code, and with it is stored the
correction factor, the inner product of the vector and its code. The inner product of two vectors is estimated without
bias as that of one vector's coarse form with the other's code over the factor; its confidence bound tells whether the
pair may reach the threshold. Only such pairs are computed again, in double precision.

Pairs to estimate come from buckets: bits of several further rotations. Their number of bits grows with the logarithm
of the vectors and the number of tables is what a pair at the threshold needs to be met with the target recall. A bucket
of many vectors is cut into chunks, each two of which meet, so that no task holds a crowded one whole. A task sends the
links of a forest of the pairs within the bound, not the pairs. Vectors that these hold together are a family; all its
pairs are computed and counted where its vectors are. Large families are cut into chunks as well.

Vectors that are null, zero, or hold null or non-finite components link with nothing; so do those of other lengths and
rows with a null id. Rows that repeat an id are one vector, the smallest. An empty table gives no rows. Labels and other
columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mix, release
from .components import Forest, components, forest
from .jaccard import grouped

THRESHOLD, RECALL = 0.95, 0.9999
#: Standard deviations of an estimate within which a pair is computed again.
SURE = 4.0
#: Vectors of a bucket, and of a family, compared together.
BUCKET, CHUNK = 2048, 1024

_rotations: dict[tuple[int, int], np.ndarray] = {}


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random rotation, the same everywhere."""
    if (dim, seed) not in _rotations:
        q, r = np.linalg.qr(np.random.default_rng([dim, seed]).standard_normal((dim, dim)))
        _rotations[dim, seed] = q * np.sign(np.diag(r))
    return _rotations[dim, seed]


def tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a bucket and number of tables for n vectors."""
    bits = max(6, math.ceil(math.log2(max(2, n))) - 4)
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - met))


def coded(vectors: DataFrame, bits: int, count: int) -> DataFrame:
    """vec_id, code (signs, factor, coarse form) and keys (a bucket for each table) of sound vectors (vec_id, embedding)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b["embedding"]
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = flat[starts[at][:, None] + np.arange(dim)]
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                turned = x @ rotation(dim, 0)
                factor = np.abs(turned).sum(axis=1) / math.sqrt(dim)
                coarse = np.rint(turned * 127).astype(np.int8)
                signs = np.packbits(turned > 0, axis=1)
                heads = np.stack([factor, np.full(len(at), dim)], axis=1).astype("<f4")
                code = [h.tobytes() + s.tobytes() + c.tobytes() for h, s, c in zip(heads, signs, coarse, strict=True)]
                # a fresh rotation gives dim bits
                own = np.concatenate([x @ rotation(dim, 1 + k) for k in range(-(-bits * count // dim))], axis=1)[:, : bits * count] > 0
                value = own.reshape(len(at), count, bits) @ (1 << np.arange(bits, dtype=np.uint64))
                keys = mix(mix(value + (np.arange(count, dtype=np.uint64) << np.uint64(44))) + np.uint64(dim)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b["vec_id"].take(pa.array(at)), pa.array(code, pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], ["vec_id", "code", "keys"])

    return vectors.mapInArrow(run, "vec_id long, code binary, keys array<long>")


def near(codes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: links that hold together the vectors of each bucket whose estimate may reach the threshold."""
    rows = materialize(codes.select("vec_id", F.explode("keys").alias("key")), "keys")
    sizes = materialize(rows.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("k"), F.count("*").alias("size")).where("size > 1").drop("size"), "sizes")
    rows = rows.join(sizes, "key")
    part = F.pmod(F.xxhash64("vec_id", "key"), F.col("k")).cast("int")
    whole = rows.where("k = 1").select("vec_id", "key")
    cut = rows.where("k > 1").withColumn("part", part).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    cut = cut.select("vec_id", F.xxhash64("key", F.least("part", "o"), F.greatest("part", "o")).alias("key"))
    rows = whole.unionByName(cut).join(codes.select("vec_id", "code"), "vec_id")
    n = int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Forest()
        for t in grouped(it, "key"):
            key = t["key"].to_numpy()
            ids = t["vec_id"].to_numpy()
            raw = t["code"].to_pylist()
            cut = np.append(np.flatnonzero(np.diff(key, prepend=key[0] - 1)), len(key))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if j - i > 1:
                    f.add(bucket_links(ids[i:j], raw[i:j], threshold))
        yield from f.sent()

    return rows.select("key", "vec_id", "code").repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def bucket_links(ids: np.ndarray, raw: list[bytes], threshold: float) -> list[tuple[int, int]]:
    """A forest of a bucket's pairs within the bound: each vector taken is compared with those not yet reached."""
    head = np.frombuffer(b"".join(x[:8] for x in raw), dtype="<f4").reshape(-1, 2)
    factor, dim = head[:, 0].astype(np.float64), int(head[0, 1])
    wide = -(-dim // 8)
    signs = np.unpackbits(np.frombuffer(b"".join(x[8 : 8 + wide] for x in raw), dtype=np.uint8).reshape(len(raw), wide), axis=1, count=dim).astype(np.float32) * 2 - 1
    coarse = np.frombuffer(b"".join(x[8 + wide :] for x in raw), dtype=np.int8).reshape(len(raw), dim).astype(np.float32) / 127
    # at the threshold an estimate errs by the part of the vector across the other, seen through the code
    bound = SURE * math.sqrt(1 - threshold**2) * np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(1, dim - 1)) + 0.02
    out = []
    left = np.arange(len(ids))
    while len(left):
        todo = [int(left[0])]
        left = left[1:]
        while todo and len(left):
            v = todo.pop()
            one = signs[left] @ coarse[v] / math.sqrt(dim) / factor[left] + bound[left] >= threshold
            two = coarse[left] @ signs[v] / math.sqrt(dim) / factor[v] + bound[v] >= threshold
            hit = one | two
            for w in left[hit].tolist():
                out.append((int(ids[v]), int(ids[w])))
                todo.append(w)
            left = left[~hit]
    return out


def proven(families: DataFrame, vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, links: for each vector a its links in parts to be summed, and a link to b that holds linked ones together (null where it is the smallest)."""
    members = families.union(families.select("b", "b").distinct()).toDF("vec_id", "family")
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("k"))
    members = members.join(sizes, "family").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("k")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    members = members.select("vec_id", "part", F.xxhash64("family", F.least("part", "o"), F.greatest("part", "o")).alias("g"), (F.col("part") != F.col("o")).alias("cross"))
    rows = members.join(vectors, "vec_id").select("g", "cross", "part", "vec_id", "embedding")
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(it, "g"):
            g, ids, part = (t[c].to_numpy() for c in ("g", "vec_id", "part"))
            cross = t["cross"].to_numpy(zero_copy_only=False).astype(bool)
            lists = t["embedding"].combine_chunks()
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype(np.float64)
            cut = np.append(np.flatnonzero(np.diff(g, prepend=g[0] - 1)), len(g))
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                x = flat[offsets[i] : offsets[j]].reshape(j - i, -1)
                x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])  # by powers of two, which is exact; squares stay finite
                own = ids[i:j]
                norm = np.sqrt((x * x).sum(axis=1))
                linked = x @ x.T / norm[:, None] / norm[None, :] >= threshold
                np.fill_diagonal(linked, False)
                if cross[i]:
                    linked &= part[i:j, None] != part[None, i:j]
                a, b = np.nonzero(np.triu(linked))
                roots = dict(forest(zip(own[a].tolist(), own[b].tolist(), strict=True)))
                count = linked.sum(axis=1)
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array([roots.get(v) for v in own[at].tolist()], pa.int64()), pa.array(count[at])], ["a", "b", "links"])

    return rows.repartition(n, "g").sortWithinPartitions("g").mapInArrow(run, "a long, b long, links long")


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """A row for each vector: vec_id, n_links, component_id (smallest vec_id reached by links), kept."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    x = F.col("embedding")
    sound = x.isNotNull() & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(x, lambda v: v != 0)
    vectors = rows.where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    if not vectors.groupBy("vec_id").count().where("count > 1").isEmpty():
        vectors = vectors.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    codes = materialize(coded(vectors, *tables(vectors.count(), threshold, recall)), "codes")
    families = components(near(codes, threshold))
    links = materialize(proven(families, vectors, threshold), "links")
    release(codes, families)
    roots = components(links.where("b is not null")).select(F.col("a").alias("vec_id"), F.col("b").alias("root"))
    counts = links.groupBy(F.col("a").alias("vec_id")).agg(F.sum("links").alias("n"))
    out = rows.select("vec_id").join(counts, "vec_id", "left").join(roots, "vec_id", "left")
    root = F.coalesce("root", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), root.alias("component_id"), root.eqNullSafe(F.col("vec_id")).alias("kept"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL),
ok AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
