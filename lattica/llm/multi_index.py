"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes are signs after several iteratively quantised rotations, fitted on a bounded, hash-chosen sample. In each block of
rows every byte of the codes is indexed. A query probes the bytes that lie within s bits of its own, for s = 0, 1, 2
...; by the pigeonhole principle all codes within ``bytes * (s + 1) - 1`` bits have then been met. It stops once enough
of them are known, takes the codes within the smallest radius that holds so many, and reranks them by the exact inner
product in double precision. Where the buckets of the next s hold more entries than the block has codes, as they do on
vectors without structure, the codes themselves are read instead, which meets all of them. Blocks return each query's
best, which are merged.

Every row is indexed, and shuffled once, to one block; the query set streams through each block in batches, so that a
task holds the rows of one block, bounded in number and bytes, and never a bucket, a key or the query set. Measured
recall is in the README.

Defined cases: vectors that are null, zero, of another length than most (ties: the longer), or hold null or non-finite
components take no part, nor do rows without vec_id; of repeated query ids the smallest vector asks; rows with the
query's own id are no candidates; repeated candidate rows each count; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lattica.llm._common import table

K, QUERY_EVERY = 20, 20
BITS, SAMPLE = 256, 8192
#: Rows and bytes of vectors of a block at most, and rows from which a block is split further to have work for all cores.
BLOCK_ROWS, BLOCK_BYTES, SPLIT_ROWS = 131_072, 32 << 20, 4096
#: A query looks at this many codes of a block, and at this share of it, before it stops widening its radius.
LEAST, SHARE = 400, 0.025
#: Queries that meet a block at once, and distances that are held for them.
QUERIES, DISTANCES = 64, 1 << 22

#: Bytes at each distance from a byte.
_NEAR = [[np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8) ^ np.uint8(v)) == s) for s in range(9)] for v in range(256)]


@dataclass
class Codes:
    mean: np.ndarray
    rotation: np.ndarray  # dimensions x bits

    @classmethod
    def fit(cls, sample: np.ndarray, bits: int = BITS, rounds: int = 20, seed: int = 5) -> Codes:
        """Iterative quantisation from several random rotations, until there are enough bits."""
        rng, mean = np.random.default_rng(seed), sample.mean(axis=0)
        x, parts = sample - mean, []
        while sum(p.shape[1] for p in parts) < bits:
            r = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))[0]
            for _ in range(rounds):
                u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
                r = u @ vt
            parts.append(r)
        return cls(mean, np.concatenate(parts, axis=1)[:, :bits])

    def of(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector."""
        return np.packbits((x - self.mean) @ self.rotation > 0, axis=1)


class Block:
    """Rows of one block with an index of each byte of their codes."""

    def __init__(self, codes: Codes, ids: np.ndarray, x: np.ndarray):
        self.codes, self.ids, self.x = codes, ids, x
        own = np.concatenate([codes.of(x[at : at + 8192]) for at in range(0, len(x), 8192)]) if len(x) else np.zeros((0, BITS // 8), np.uint8)
        self.width = own.shape[1]
        self.wide = np.ascontiguousarray(own).view(np.uint64)
        self.order = [np.argsort(own[:, j], kind="stable").astype(np.int32) for j in range(self.width)]
        self.sizes = np.stack([np.bincount(own[:, j], minlength=256) for j in range(self.width)])
        self.starts = np.cumsum(self.sizes, axis=1) - self.sizes

    def bucket(self, j: int, v: int) -> np.ndarray:
        return self.order[j][self.starts[j, v] : self.starts[j, v] + self.sizes[j, v]]

    def near(self, code: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Rows met by probing and their distances, once ``want`` are within the complete radius; None: read all codes."""
        met = np.zeros(0, np.int32)
        for s in range(8):
            values = [_NEAR[v][s] for v in code]
            if len(met) + sum(int(self.sizes[j, v].sum()) for j, v in enumerate(values)) >= len(self.ids):
                return None
            met = np.unique(np.concatenate([met, *[self.bucket(j, v) for j, own in enumerate(values) for v in own]]))
            far = np.bitwise_count(self.wide[met] ^ code.view(np.uint64)).sum(axis=1, dtype=np.int32)
            inside = far < self.width * (s + 1)
            if inside.sum() >= want:
                return met[inside], far[inside]
        return None

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, least: int, share: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query id, row id, score) of the best rows found for each query."""
        n = len(self.ids)
        want = min(n, max(least, int(share * n)))
        asked = self.codes.of(q)
        probed = [self.near(c, want) for c in asked]
        step = max(1, DISTANCES // max(1, n))
        unsure = [i for i, p in enumerate(probed) if p is None]
        for at in range(0, len(unsure), step):
            some = unsure[at : at + step]
            far = np.zeros((len(some), n), np.uint16)
            for w, mine in enumerate(np.ascontiguousarray(asked[some]).view(np.uint64).T):
                far += np.bitwise_count(self.wide[None, :, w] ^ mine[:, None])
            radius = np.partition(far, want - 1, axis=1)[:, want - 1]
            for i, f, r in zip(some, far, radius, strict=True):
                yield self.ranked(np.flatnonzero(f <= r), query_ids[i], q[i], k)
        for i, p in enumerate(probed):
            if p is not None:
                rows, far = p
                yield self.ranked(rows[far <= np.partition(far, want - 1)[want - 1]], query_ids[i], q[i], k)

    def ranked(self, rows: np.ndarray, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        chosen = rows[self.ids[rows] != query_id]
        if len(chosen) < k:
            chosen = np.flatnonzero(self.ids != query_id)
        score = (self.x[chosen].astype(float) * q).sum(axis=1)
        if len(chosen) > 4 * k:
            limit = np.partition(score, len(score) - k)[len(score) - k]
            chosen, score = chosen[score >= limit], score[score >= limit]
        best = np.lexsort((self.ids[chosen], -score))[:k]
        return np.full(len(best), query_id), self.ids[chosen[best]], score[best]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fitted(sample: DataFrame) -> Codes:
    """Codes from a sample, fitted in one task: workers run linear algebra on one thread, and no vector is collected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_matrix(b.column(0)).astype(float) for b in batches if b.num_rows]
        if got:
            codes = Codes.fit(np.concatenate(got))
            yield pa.RecordBatch.from_arrays([pa.array([m.astype(float).tobytes()], pa.binary()) for m in (codes.mean, codes.rotation)], ["mean", "rotation"])

    row = sample.repartition(1).mapInArrow(run, "mean binary, rotation binary").first()
    mean = np.frombuffer(bytes(row.mean))
    return Codes(mean, np.frombuffer(bytes(row.rotation)).reshape(len(mean), -1))


def nearest(rows: DataFrame, queries: DataFrame, k: int = K, sample: int = SAMPLE, block_rows: int | None = None, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score) for rows and queries of (vec_id, embedding)."""
    spark = rows.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        kind = df.schema["embedding"].dataType
        single = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType)  # half the bytes, the same numbers
        v = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v")).filter("vec_id is not null and v is not null")
        return v.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))

    base = usable(rows)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    dim, n = sizes[0].d, sizes[0]["count"]
    base = base.filter(F.size("v") == dim)
    asked = usable(queries).filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    codes = fitted(base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v"))
    shared = spark.sparkContext.broadcast(codes)
    width = 4 if dict(base.dtypes)["v"] == "array<float>" else 8
    most = block_rows or max(1, min(BLOCK_ROWS, BLOCK_BYTES // (dim * width)))
    wished = min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // SPLIT_ROWS) if block_rows is None else 1
    blocks = max(1, -(-n // most), wished)
    # a number for each row: repeats of one id are dealt to all blocks
    dealt = base.withColumns({"block": F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)), "asks": F.lit(False)})
    asking = asked.withColumns({"block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))), "asks": F.lit(True)})
    names = ["block", "asks", "vec_id", "v"]
    # more partitions than blocks, so that few of them share one
    both = dealt.select(names).unionAll(asking.select(names)).repartition(4 * blocks, "block").sortWithinPartitions("block", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for b in batches:
            number, asks = b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
            cut = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(number)], strict=True):
                if s == e:
                    continue
                if number[s] != now:
                    now, held, block = number[s], [], None
                ids, v = b.column(2).slice(s, e - s).to_numpy(), _matrix(b.column(3).slice(s, e - s))
                if not asks[s]:
                    held.append((ids.copy(), v.copy()))
                    continue
                if not held and block is None:
                    continue
                if block is None:
                    block = Block(shared.value, np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]))
                    held = []
                for at in range(0, e - s, QUERIES):
                    found = list(block.search(ids[at : at + QUERIES], v[at : at + QUERIES].astype(float), k, least, share))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    best = both.mapInArrow(run, "query_id long, vec_id long, score double")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.filter(F.col("vec_id") % QUERY_EVERY == 0))
