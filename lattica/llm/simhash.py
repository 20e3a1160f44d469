"""SimHash near-duplicates with a bit-sliced comparison of fingerprints.

Fingerprints within ``RADIUS`` bits are linked. Their 64 bits are cut into six pieces; two fingerprints within four
bits agree on at least two pieces whole, so each fingerprint goes into the 15 buckets of its pairs of pieces and no
link is lost. Rows of a bucket are compared by bit planes: bit b of all fingerprints of a block stands in one packed
vector, differences are added into carry-save counters, and rows stop as soon as all of their counters exceed the
radius. A bucket with more than ``LARGEST`` different fingerprints is dealt again by single ones of five pieces of its
remaining bits, one of which four flips leave whole, so that again nothing is lost; the masks gain bits each time, and
a bucket with 12 bits left can't be too large any more. Equal fingerprints are one node, and
a block returns a spanning forest, never all pairs.

Defined cases: null or blank texts have fingerprint zero and link like any other; rows with a null doc_id get their
fingerprint and the component's smallest known doc_id; repeated rows and ties share a component; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._common import slices, table, written
from lattica.llm._components import components

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Different fingerprints of a bucket that are compared as they are, and rows of a tile.
LARGEST, TILE = 4096, 512


def shingles(text: str | None, k: int) -> np.ndarray:
    """Hashes of the k-word shingles, repeats included; of the whole sequence, if it is shorter; none without words."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    flat, n = b" ".join(ws), max(1, len(ws) - k + 1)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.array([h(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is 1 if set in over half of the shingles' hashes."""
    return majority(shingles(text, k))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp); fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def pieces_masks(free: list[int], pieces: int = RADIUS + 2, agree: int = 2) -> list[int]:
    """Masks of ``agree`` out of ``pieces`` pieces of the free bits: any RADIUS flips leave one of them untouched."""
    cut = [free[len(free) * i // pieces : len(free) * (i + 1) // pieces] for i in range(pieces)]
    return [sum(1 << b for piece in chosen for b in piece) for chosen in combinations(cut, agree)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def within(rows: np.ndarray, cols: np.ndarray, radius: int, triangle: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with at most ``radius`` differing bits between rows[i] and cols[j]; j > i only, if triangle."""
    m, words = len(cols), -(-len(cols) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:m] = cols
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)  # 64 x words
    skip = np.zeros((len(rows), words * 64), np.uint8)
    skip[:, m:] = 1
    if triangle:
        skip[:, : len(rows)] |= np.tril(np.ones((len(rows), len(rows)), np.uint8))[:, : words * 64]
    over = np.packbits(skip, axis=1, bitorder="little").view(np.uint64)
    alive = np.arange(len(rows))
    width = max(1, radius.bit_length())
    counters = [np.zeros_like(over) for _ in range(width)]
    ones, full = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    for plane in range(64):
        flip = np.where((rows[alive] >> np.uint64(plane)) & np.uint64(1), ones, full)
        carry = planes[plane][None, :] ^ flip[:, None]
        for c in counters:
            carry, c[...] = c & carry, c ^ carry
        over |= carry
        if plane % 8 == 7:
            exceeded, equal = over, None
            for b in range(width - 1, -1, -1):
                c = counters[b]
                if radius >> b & 1:
                    equal = c if equal is None else equal & c
                else:
                    exceeded = exceeded | (c if equal is None else equal & c)
                    equal = ~c if equal is None else equal & ~c
            over = exceeded
            live = (over != ones).any(axis=1)
            if not live.all():
                alive, over, counters = alive[live], over[live], [c[live] for c in counters]
                if not len(alive):
                    break
    if not len(alive):
        return alive, alive
    i, j = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
    return alive[i], j


def forest(fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fps: (fp, smaller fp of its tree)."""
    label = np.arange(len(fps))
    for a in range(0, len(fps), TILE):
        for b in range(a, len(fps), TILE):
            i, j = within(fps[a : a + TILE], fps[b : b + TILE], radius, a == b)
            i, j = i + a, j + b
            while len(i):
                x, y = label[i], label[j]
                differ = x != y
                if not differ.any():
                    break
                i, j, x, y = i[differ], j[differ], x[differ], y[differ]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while (label[label] != label).any():
                    label = label[label]
    moved = label != np.arange(len(fps))
    return fps[moved], fps[label[moved]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each bucket of rows sorted by (mask, value, fp); rows of too large buckets come back with their mask.

    Small buckets are compared together: a link across buckets is checked like any other and is a true link.
    """
    names = ["mask", "a", "b"]
    waiting: list[np.ndarray] = []  # small buckets that are compared in one block
    bucket: list[np.ndarray] = []  # the open bucket; gives way to streaming once it is too large
    key, held, streaming = None, 0, False

    def flush() -> Iterator[pa.RecordBatch]:
        if waiting:
            a, b = forest(np.unique(np.concatenate(waiting)))
            waiting.clear()
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names)

    def hot(fps: np.ndarray, mask: int) -> pa.RecordBatch:
        own = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(own), mask, np.int64)), pa.array(own), pa.array(own)], names)

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal bucket, held, streaming
        if held > 1 and not streaming:
            if sum(map(len, waiting)) + held > TILE:
                yield from flush()
            waiting.append(np.concatenate(bucket))
        bucket, held, streaming = [], 0, False

    for batch in batches:
        mask, value, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(fp):
            continue
        fp = np.ascontiguousarray(fp).view(np.uint64)
        new = np.flatnonzero((mask[1:] != mask[:-1]) | (value[1:] != value[:-1])) + 1
        starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(fp)]))
        keep = ends - starts > 1
        keep[[0, -1]] = True  # those may go on in another batch
        for s, e in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            if key != (own := (mask[s], value[s])):
                yield from close()
                key = own
            if streaming:
                yield hot(fp[s:e], int(own[0]))
                continue
            bucket.append(fp[s:e])
            held += e - s
            if held > LARGEST:
                yield hot(np.concatenate(bucket), int(own[0]))
                bucket, streaming = [], True
    yield from close()
    yield from flush()


def links(fps: DataFrame) -> DataFrame:
    """Spanning links (a, b) among different fingerprints (column fp) that are within the radius."""
    spark = fps.sparkSession
    masks = {0: [_signed(m) for m in pieces_masks(list(range(64)))]}
    rows, found = fps.select(F.lit(0).cast("long").alias("parent"), "fp"), None
    while True:
        more = spark.createDataFrame([(k, v) for k, v in masks.items()], "parent long, masks array<long>") if len(masks) > 1 else None
        options = F.array(*[F.lit(m).cast("long") for m in masks[0]]) if more is None else F.col("masks")
        rows = rows if more is None else rows.join(F.broadcast(more), "parent")  # a row for each mask of the round before: at most 15 * 5**(round - 1)
        dealt = rows.select(F.explode(options).alias("mask"), "fp").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("value"), "fp")
        dealt = dealt.repartition("mask", "value").sortWithinPartitions("mask", "value", "fp")
        out = written(dealt.mapInArrow(_compare, "mask long, a long, b long"), "links")
        found = out.filter("mask = 0").select("a", "b") if found is None else found.union(out.filter("mask = 0").select("a", "b"))
        rest = out.filter("mask <> 0")
        if rest.isEmpty():
            return found
        used = [r[0] for r in rest.select("mask").distinct().collect()]
        masks = {m: [_signed((m % (1 << 64)) | s) for s in pieces_masks([b for b in range(64) if not m >> b & 1], RADIUS + 1, 1)] for m in used}
        masks.setdefault(0, [])
        rows = rest.select(F.col("mask").alias("parent"), F.col("a").alias("fp")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    own = written(fingerprints(docs), "fingerprints")
    nodes = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp")))
    # both written, so that the joins have plain exchanges on both sides and Spark can split a large component
    rooted = written(nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    return own.join(rooted.select("fp", "root").join(least, "root").select("fp", "component_id"), "fp")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays, one if that id is repeated.

    Rows without an id can't be named by a group and stay.
    """
    chosen = near_duplicates(docs).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.join(chosen, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns).unionByName(docs.filter("doc_id is null"))
