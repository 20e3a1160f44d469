"""Fingerprints, the bit-sliced kernel, splitting of hot buckets and components against brute force."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash

from lattica.llm import simhash
from lattica.llm._components import components


def plain_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(ids, fps, radius=4):
    label = list(range(len(fps)))
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x == max(a, b) else x for x in label]
    least = {}
    for x, i in zip(label, ids, strict=True):
        least[x] = min(least.get(x, i), i)
    return [least[x] for x in label]


def test_fingerprint():
    for t in (None, "", " \n", "One", "one two three", "A b C d e F " * 30, "Ünï ÇÖDE ß é\x0bvt\x0cff", "x " * 70_000):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_spark_hash_is_the_same(spark):
    text = "a b c d"
    h = spark.sql(f"SELECT xxhash64('{text}')").first()[0] % (1 << 64)
    assert h == xxhash.xxh64_intdigest(text.encode(), 42) == simhash.fingerprint(text)


def test_kernel():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = np.concatenate([base, *[base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for k in range(1, 8)]])
    for radius in (0, 1, 3, 4, 7):
        i, j = simhash.within(near[:130], near, radius, False)
        want = np.argwhere(np.bitwise_count(near[:130, None] ^ near[None, :]) <= radius)
        assert sorted(zip(i, j, strict=True)) == sorted(map(tuple, want))
    i, j = simhash.within(near, near, 4, True)
    assert (j > i).all()


def test_every_pair_shares_a_mask():
    rng = np.random.default_rng(1)
    free = list(range(64))
    masks = simhash.pieces_masks(free)
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, False))
        assert any(not m & flips for m in masks)
    inner = simhash.pieces_masks([b for b in free if not masks[0] >> b & 1])
    assert all(not m & masks[0] for m in inner)


def test_hot_buckets_are_dealt_again(spark, monkeypatch):
    rng = np.random.default_rng(2)
    center = int(rng.integers(0, 1 << 62))
    fps = sorted({center ^ sum(1 << int(b) for b in rng.choice(64, int(k), False)) for k in rng.integers(0, 9, 300)})
    # workers import the module anew, so the limit is set in a copy of the function's globals
    hot = type(simhash._compare)(simhash._compare.__code__, {**simhash._compare.__globals__, "LARGEST": 40, "__name__": "__main__"}, "_compare", None, None)
    hot.__module__ = "__main__"
    monkeypatch.setattr(simhash, "_compare", hot)
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(df)).collect()}
    got = [roots.get(simhash._signed(f), simhash._signed(f)) for f in fps]
    want = classes([simhash._signed(f) for f in fps], np.array(fps, np.uint64))
    assert got == want


def test_buckets_across_batches():
    fps = np.array([7, 7 ^ 1, 7 ^ 3, 1 << 40, 5 << 50], np.uint64).view(np.int64)
    value = np.array([1, 1, 1, 2, 3], np.int64)
    mask = np.ones(5, np.int64)
    batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + 1]) for c in (mask, value, fps)], ["mask", "value", "fp"]) for i in range(5)]
    out = [r for b in simhash._compare(iter(batches)) for r in b.to_pylist()]
    assert {(r["a"], r["b"]) for r in out} == {(6, 4), (7, 4)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (300, 200), (7, 7)]
    out = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {i: 1 for i in range(1, 61)} | {100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    fps = np.array([plain_fingerprint(d.text) for d in docs], np.uint64)
    want = dict(zip([d.doc_id for d in docs], zip([f"{f:016x}" for f in fps.tolist()], classes([d.doc_id for d in docs], fps), strict=True), strict=True))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op9_simhash(spark, small).collect()} == want


def test_defined_cases(spark, awkward, empty):
    out = simhash.near_duplicates(awkward)
    assert out.count() == awkward.count()
    zero = out.filter("fp = 0").select("component_id").distinct().collect()
    assert zero == [(2,)]
    kept = simhash.simhash_stage(spark, awkward, "")
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 2, 5, 6]
    assert kept.filter("doc_id is null").count() == 2
    assert simhash.near_duplicates(empty).count() == 0
