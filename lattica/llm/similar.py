"""SimHash near-duplicates at a similarity of word shingles, for texts that differ too much for a few bits.

A pair at a Jaccard similarity of 0.8 differs in about ten of 64 fingerprint bits, too many to find it by pieces of
fingerprints. Here the blocks that the bit-sliced comparison runs over are made of texts that share the least of their
shingle hashes under one of ``TABLES`` orders: two texts of similarity s miss each other with (1 - s) ** TABLES. Pairs
within ``RADIUS`` bits are estimated from small sketches (one byte for each of 256 bins of the shingles), those that may
be similar become links, each of which is checked exactly on the texts.

That is done twice. First each block keeps links that span it and the best of the doubtful ones, which ties most of what
belongs together at little cost. Then ``rest`` gives every link that may hold between texts that the checked links leave
apart, and all of them are checked, so that the groups are those of checking every pair of the blocks.

A bucket with more than ``LARGEST`` different texts is dealt again by the next ``TABLES`` orders; after ``ROUNDS`` of
them its texts have so many least hashes in common that they are compared in blocks, the first time each with the first
rows of the bucket, the second time each with each.

Defined cases: texts without words are alike; texts shorter than a shingle are one shingle; texts with equal shingle
sets are one node; rows with a null doc_id take part and come after all others; repeated rows are one; an empty table
stays empty; further columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._common import slices, written
from lattica.llm._components import components
from lattica.llm.chains import in_filter
from lattica.llm.line_chunks import bit_filter
from lattica.llm.simhash import LARGEST, TILE, majority, shingles, within

SHINGLE, SIMILARITY = 5, 0.8
#: Bits that a pair of this similarity practically never exceeds (mean 10, deviation 3), and what sketches may be off.
RADIUS, MARGIN = 20, 0.06
#: Doubtful pairs of a tree that are checked the first time.
DOUBTFUL = 4
TABLES, ROUNDS, PIVOTS = 4, 4, 64
BINS = 256

_RNG = np.random.default_rng(9)
_TIMES = _RNG.integers(0, 1 << 63, TABLES * ROUNDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted different shingle hashes; a text without words has the one hash of nothing."""
    h = shingles(text, k)
    return np.unique(h) if len(h) else np.array([xxhash.xxh64_intdigest(b"")], np.uint64)


def sketch(own: np.ndarray) -> np.ndarray:
    """A byte for the least hash of each bin, from 1; 0 for an empty bin."""
    at, first = np.unique((own >> np.uint64(56)).astype(np.int64), return_index=True)
    out = np.zeros(BINS, np.uint8)
    low = own[first]
    out[at] = 1 + ((low ^ low >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) % np.uint64(255)
    return out


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of each pair of sketches."""
    return ((a == b) & (a > 0)).sum(axis=1) / np.maximum(1, ((a | b) > 0).sum(axis=1))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def described(docs: DataFrame, k: int) -> DataFrame:
    """(key, doc_id, node, fp, mins, sketch) of each row; rows with equal doc_id and text share the key."""
    names = ["key", "doc_id", "node", "fp", "mins", "sketch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            node, fp, mins, small = [], [], [], []
            for text in b.column(2).to_pylist():
                h = shingles(text, k)
                own = np.unique(h) if len(h) else shingle_set(None)
                node.append(xxhash.xxh64_intdigest(own.tobytes()))
                fp.append(majority(h))
                mins.append(_signed((own[:, None] * _TIMES).min(axis=0)))
                small.append(sketch(own).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(_signed(np.array(x, np.uint64))) for x in (node, fp)], pa.array(mins, pa.list_(pa.int64())), pa.array(small, pa.binary())], names)

    own = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "key long, doc_id long, node long, fp long, mins array<long>, sketch binary")


def merging(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that connect different trees, one for each tree and round; ``label`` is changed in place."""
    left, right = [i[:0]], [j[:0]]
    while True:
        x, y = label[i], label[j]
        differ = x != y
        if not differ.any():
            return np.concatenate(left), np.concatenate(right)
        i, j, x, y = i[differ], j[differ], x[differ], y[differ]
        least, n = np.full(len(label), len(i)), np.arange(len(i))
        np.minimum.at(least, x, n)
        np.minimum.at(least, y, n)
        e = np.unique(least[least < len(i)])
        left.append(i[e])
        right.append(j[e])
        np.minimum.at(label, np.maximum(x[e], y[e]), np.minimum(x[e], y[e]))
        while (label[label] != label).any():
            label[:] = label[label]


def foremost(label: np.ndarray, i: np.ndarray, j: np.ndarray, estimate: np.ndarray) -> np.ndarray:
    """Which of the pairs are among the ``DOUBTFUL`` best of either of their trees."""
    tree, pair = np.concatenate([label[i], label[j]]), np.tile(np.arange(len(i)), 2)
    order = np.lexsort((-estimate[pair], tree))
    first = np.concatenate(([True], tree[order][1:] != tree[order][:-1])) if len(order) else np.zeros(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return np.unique(pair[order[place < DOUBTFUL]])


def forest(fps: np.ndarray, sketches: np.ndarray, similarity: float, pivots: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs within the radius: those that span the pairs whose estimate is well above the similarity, and
    the best doubtful ones of each tree of them. With ``pivots`` only pairs within a tile or with the first rows count.
    """
    label = np.arange(len(fps))
    left, right = [label[:0]], [label[:0]]
    doubtful = [(label[:0], label[:0], np.zeros(0))]
    for a in range(0, len(fps), TILE):
        for b in range(a, len(fps), TILE):
            if pivots and a and a != b:
                continue
            rows = fps[a : a + (pivots if pivots and a != b else TILE)]
            i, j = within(rows, fps[b : b + TILE], RADIUS, a == b)
            i, j = i + a, j + b
            for at in range(0, len(i), 1 << 15):
                p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                differ = label[p] != label[q]
                p, q = p[differ], q[differ]
                near = estimates(sketches[p], sketches[q])
                sure = near >= similarity + MARGIN
                maybe = (near >= similarity - MARGIN) & ~sure
                x, y = merging(label, p[sure], q[sure])
                left.append(x)
                right.append(y)
                p, q, near = p[maybe], q[maybe], near[maybe]
                keep = foremost(label, p, q, near)
                doubtful.append((p[keep], q[keep], near[keep]))
    p, q, near = (np.concatenate(c) for c in zip(*doubtful, strict=True))
    differ = label[p] != label[q]
    p, q, near = p[differ], q[differ], near[differ]
    keep = foremost(label, p, q, near)
    return np.concatenate([*left, p[keep]]), np.concatenate([*right, q[keep]])


def links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between nodes that may be similar, from columns node, fp, mins and sketch."""

    def compare(last: bool):
        names = ["bucket", "a", "b"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            waiting: list[tuple[np.ndarray, ...]] = []  # small buckets, compared in one block
            bucket: list[tuple[np.ndarray, ...]] = []
            key, held, streaming = None, 0, False

            def batch(bucket_key: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), bucket_key, np.int64)), pa.array(a), pa.array(b)], names)

            def linked(parts: list[tuple[np.ndarray, ...]], pivots: int | None = None) -> Iterator[pa.RecordBatch]:
                node, fp, small = (np.concatenate(c) for c in zip(*parts, strict=True))
                node, first = np.unique(node, return_index=True) if not pivots else (node, np.arange(len(node)))
                i, j = forest(fp[first].view(np.uint64), small[first], similarity, pivots)
                if len(i):
                    yield batch(0, node[i], node[j])

            def flush() -> Iterator[pa.RecordBatch]:
                if waiting:
                    yield from linked(waiting)
                    waiting.clear()

            def close() -> Iterator[pa.RecordBatch]:
                nonlocal bucket, held, streaming
                if streaming and last and bucket:
                    yield from linked(bucket, PIVOTS)
                elif held > TILE and not streaming:
                    yield from linked(bucket)
                elif held > 1 and not streaming:
                    if sum(len(p[0]) for p in waiting) + held > TILE:
                        yield from flush()
                    waiting.extend(bucket)
                bucket, held, streaming = [], 0, False

            for b in batches:
                if not b.num_rows:
                    continue
                own, node, fp = (b.column(k).to_numpy() for k in range(3))
                small = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(-1, BINS)
                cut = np.flatnonzero(own[1:] != own[:-1]) + 1
                starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(own)]))
                keep = ends - starts > 1
                keep[[0, -1]] = True  # those may go on in another batch
                for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
                    if key != own[s]:
                        yield from close()
                        key = own[s]
                    if streaming and not last:
                        yield batch(int(key), node[s:e], node[s:e])
                        continue
                    bucket.append((node[s:e].copy(), fp[s:e].copy(), small[s:e].copy()))
                    held += e - s
                    if held > LARGEST:
                        if last:
                            every = [np.concatenate(c) for c in zip(*bucket, strict=True)]
                            yield from linked([tuple(every)], PIVOTS)
                            bucket, held, streaming = [tuple(c[:PIVOTS] for c in every)], PIVOTS, True
                        else:
                            for p in bucket:
                                yield batch(int(key), p[0], p[0])
                            bucket, streaming = [], True
            yield from close()
            yield from flush()

        return run

    rows, found = nodes.withColumn("bucket", F.lit(0).cast("long")), None
    for n in range(ROUNDS):
        keys = F.array(*[F.xxhash64("bucket", F.lit(k), F.col("mins")[k]) for k in range(n * TABLES, (n + 1) * TABLES)])
        dealt = rows.select(F.explode(keys).alias("bucket"), "node", "fp", "sketch").repartition("bucket").sortWithinPartitions("bucket", "node")
        out = written(dealt.mapInArrow(compare(n + 1 == ROUNDS), "bucket long, a long, b long"), "links")
        own = out.filter("bucket = 0").select("a", "b")
        found = own if found is None else found.unionAll(own)
        hot = out.filter("bucket <> 0").select("bucket", F.col("a").alias("node"))
        if n + 1 == ROUNDS or hot.isEmpty():
            return found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        rows = nodes.join(hot, "node")


def apart(fps: np.ndarray, sketches: np.ndarray, roots: np.ndarray, similarity: float, sides: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs within the radius that may be similar and have different roots, and different sides if given."""
    for a in range(0, len(fps), TILE):
        for b in range(a, len(fps), TILE):
            own, other = roots[a : a + TILE], roots[b : b + TILE]
            if own[0] == other[0] and (own == own[0]).all() and (other == own[0]).all():
                continue
            i, j = within(fps[a : a + TILE], fps[b : b + TILE], RADIUS, a == b)
            i, j = i + a, j + b
            differ = roots[i] != roots[j]
            if sides is not None:
                differ &= sides[i] != sides[j]
            i, j = i[differ], j[differ]
            for at in range(0, len(i), 1 << 15):
                p, q = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
                near = estimates(sketches[p], sketches[q]) >= similarity - MARGIN
                if near.any():
                    yield p[near], q[near]


def rest(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): all links that may hold between nodes of different roots, from columns node, fp, mins, sketch and root.

    Only buckets that hold several roots are looked at. One that is too large after the last round is cut into parts,
    each of which meets itself and each other one.
    """
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []  # small buckets, compared in one block
        bucket: list[tuple[np.ndarray, ...]] = []
        key, held = None, 0

        def linked(parts: list[tuple[np.ndarray, ...]], sided: bool = False) -> Iterator[pa.RecordBatch]:
            node, fp, root, side, small = (np.concatenate(c) for c in zip(*parts, strict=True))
            node, first = np.unique(node, return_index=True)
            for i, j in apart(fp[first].view(np.uint64), small[first], root[first], similarity, side[first] if sided else None):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal bucket, waiting, held
            if held > TILE or bucket and bucket[0][3][0] >= 0:
                yield from linked(bucket, bool(bucket[0][3][0] >= 0))
            elif held > 1:
                if sum(len(p[0]) for p in waiting) + held > TILE:
                    yield from linked(waiting)
                    waiting = []
                waiting += bucket
            bucket, held = [], 0

        for b in batches:
            if not b.num_rows:
                continue
            own, *columns = (b.column(k).to_numpy() for k in range(5))
            columns.append(np.frombuffer(b"".join(b.column(5).to_pylist()), np.uint8).reshape(-1, BINS))
            cut = np.flatnonzero(own[1:] != own[:-1]) + 1
            for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(own)], strict=True):
                if key != own[s]:
                    yield from close()
                    key = own[s]
                bucket.append(tuple(c[s:e].copy() for c in columns))
                held += e - s
        yield from close()
        if waiting:
            yield from linked(waiting)

    rows, found = nodes.withColumn("bucket", F.lit(0).cast("long")), None
    for n in range(ROUNDS):
        keys = F.array(*[F.xxhash64("bucket", F.lit(k), F.col("mins")[k]) for k in range(n * TABLES, (n + 1) * TABLES)])
        places = written(rows.select(F.explode(keys).alias("bucket"), "node", "root"), "places")
        mixed = written(places.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count(F.lit(1)).alias("n")).filter("least <> most").select("bucket", "n"), "mixed")
        if mixed.isEmpty():
            break
        dealt = written(places.join(mixed, "bucket").select("bucket", "n", "node", "root"), "dealt")
        cold, hot = dealt.filter(F.col("n") <= LARGEST), dealt.filter(F.col("n") > LARGEST)
        one = cold.select("bucket", "node", "root", F.lit(-1).cast("long").alias("side"))
        more = n + 1 < ROUNDS and not hot.isEmpty()
        if n + 1 == ROUNDS:
            parts = F.ceil(F.col("n") / LARGEST)
            part = hot.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("node", F.lit(n)), parts)})
            met = part.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
            two = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
            one = one.unionAll(met.select(two.alias("bucket"), "node", "root", F.when(F.col("part") == F.col("other"), -1).otherwise(F.col("part")).cast("long").alias("side")))
        full = one.join(nodes.select("node", "fp", "sketch"), "node").select("bucket", "node", "fp", "root", "side", "sketch")
        out = written(full.repartition("bucket").sortWithinPartitions("bucket", "root").mapInArrow(run, "a long, b long").distinct(), "rest")
        found = out if found is None else found.unionAll(out)
        if not more:
            break
        rows = nodes.join(hot.select("bucket", "node"), "node")
    return nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0) if found is None else found.distinct()


def verified(docs: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """Those of the pairs of rows (a_key, b_key, further columns) whose shingle sets are similar, by their texts."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a_key").alias("h")).union(pairs.select("b_key"))
    known = spark.sparkContext.broadcast(bit_filter(wanted))
    own = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_filter(known.value, b.column(0).to_numpy().view(np.uint64))))

    # one row for repeated rows; written, so that the joins have plain exchanges on both sides and Spark can split a text
    # with many links
    some = written(own.mapInArrow(picked, "key long, text string").dropDuplicates(["key"]), "texts")
    a, b = (some.select(F.col("key").alias(f"{x}_key"), F.col("text").alias(f"{x}_text")) for x in "ab")
    both = pairs.join(a, "a_key").join(b, "b_key")
    names, n = pairs.columns, len(pairs.columns)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "b_text"):
            keep, last, held = [], None, None
            for x, y in zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                if y != last:
                    last, held = y, shingle_set(y, k)
                own = shingle_set(x, k)
                common = len(np.intersect1d(own, held, assume_unique=True))
                keep.append(common >= similarity * (len(own) + len(held) - common))
            yield batch.filter(pa.array(keep, pa.bool_())).select(names)

    return both.select(*names, "a_text", "b_text").mapInArrow(test, pairs.schema).distinct()


def similar(docs: DataFrame, similarity: float = SIMILARITY, k: int = SHINGLE) -> DataFrame:
    """(key, doc_id, root, first): each row's component, and whether it is the component's first by doc_id, nulls last."""
    own = written(described(docs, k), "described")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    nodes = written(own.groupBy("node").agg(F.min(rank).alias("best"), *[F.min(c).alias(c) for c in ("fp", "mins", "sketch")]), "nodes")
    keys = nodes.select("node", F.col("best.key").alias("key"))

    def checked(pairs: DataFrame) -> DataFrame:
        keyed = pairs.join(keys.select(F.col("node").alias("a"), F.col("key").alias("a_key")), "a").join(keys.select(F.col("node").alias("b"), F.col("key").alias("b_key")), "b")
        return verified(docs, written(keyed, "pairs"), similarity, k).select("a", "b")

    pairs = written(links(nodes.select("node", "fp", "mins", "sketch"), similarity), "spanning")
    roots = components(checked(pairs))
    rooted = written(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    left = written(rest(rooted.select("node", "fp", "mins", "sketch", "root"), similarity).join(pairs, ["a", "b"], "left_anti"), "left")
    if not left.isEmpty():
        # a root is its component's smallest node, so that the smallest root of those linked is the new one
        root_of = rooted.select("node", "root")
        edges = checked(left).join(root_of.toDF("a", "x"), "a").join(root_of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        again = components(edges).select(F.col("node").alias("root"), F.col("root").alias("later"))
        rooted = written(rooted.join(again, "root", "left").select("node", "best", F.coalesce("later", "root").alias("root")), "rooted")
    first = written(rooted.groupBy("root").agg(F.min("best").alias("first")), "first")
    of_node = written(rooted.select("node", "root").join(first, "root"), "of_node")
    out = own.select("key", "doc_id", "node").join(of_node, "node")
    return out.select("key", "doc_id", "root", (F.col("key") == F.col("first.key")).alias("first"))


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays, one if it is repeated."""
    chosen = similar(docs).filter("first").select(F.col("key").alias("_key")).distinct()
    own = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    return own.join(chosen, "_key", "left_semi").dropDuplicates(["_key"]).select(*docs.columns)
