"""Recall and scores against brute force, and defined cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.llm import multi_index

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, v, q, own, k=20):
    s = (v * q).sum(axis=1)
    keep = ids != own
    order = np.lexsort((ids[keep], -s[keep]))[:k]
    return ids[keep][order].tolist(), s[keep][order]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").toPandas()
    ids, v = e.vec_id.to_numpy(), np.array(e.embedding.tolist(), float)
    found = multi_index.op3_multi_index(spark, f"/root/testdata/{sf}").toPandas().sort_values(["query_id", "rank"])
    hits = total = 0
    for own, g in found.groupby("query_id"):
        best, _ = brute(ids, v, v[ids == own][0], own)
        assert g["rank"].tolist() == list(range(1, 21))
        assert g["score"].to_numpy() == pytest.approx([(v[ids == i][0] * v[ids == own][0]).sum() for i in g.vec_id], abs=1e-12)
        hits, total = hits + len(set(best) & set(g.vec_id)), total + 20
    assert found.query_id.nunique() == (ids % 20 == 0).sum()
    assert hits / total >= 0.95


def test_blocks_and_ties(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 16))
    v[100:200] = v[100]  # copies: ties go to the smaller id
    df = spark.createDataFrame([(i, [float(x) for x in np.float32(r)], 0) for i, r in enumerate(v)], SCHEMA)
    small = multi_index.nearest(df, df.filter("vec_id % 20 = 0"), block_rows=200).toPandas()
    v = np.float32(v).astype(float)
    for own, g in small.groupby("query_id"):
        assert len(set(brute(np.arange(600), v, v[own], own)[0]) & set(g.vec_id)) >= 18
    tied = small[small.query_id == 100].sort_values("rank")
    assert tied.vec_id.tolist() == list(range(101, 121))


@pytest.mark.parametrize("spread", [0.02, 100.0])
def test_pigeonhole_meets_all_codes_within_the_radius(spread):
    """Near copies are found by probing alone; among scattered vectors all codes are read."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(20, 32))
    x = centers[rng.integers(0, 20, 2000)] + spread * rng.normal(size=(2000, 32))
    codes = multi_index.Codes.fit(x, 64)
    assert codes.of(x).shape == (2000, 8)
    block = multi_index.Block(codes, np.arange(2000), x)
    far = np.bitwise_count(codes.of(x).view(np.uint64) ^ codes.of(x).view(np.uint64).T).astype(int)
    for i in range(5):
        found = block.near(codes.of(x[i : i + 1])[0], 40)
        assert (found is None) == (spread == 100.0)
        if found is not None:
            s = int(found[1].max()) // 8
            assert set(found[0].tolist()) == set(np.flatnonzero(far[i] < 8 * (s + 1)).tolist())
    got = list(block.search(np.arange(5) + 10_000, x[:5], 20, 2000, 1.0))
    for i in range(5):
        assert next(r for q, r, _ in got if q[0] == i + 10_000).tolist() == brute(np.arange(2000), x, x[i], -1)[0]


def test_recall_over_several_blocks(spark):
    """80,000 vectors without structure in four blocks; a hundred queries."""
    rng = np.random.default_rng(6)
    v = np.float32(rng.normal(size=(80_000, 32)))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(80_000), "embedding": v.tolist()})).select("vec_id", F.col("embedding").cast("array<float>"))
    found = multi_index.nearest(df, df.filter("vec_id % 800 = 0"), block_rows=20_000).toPandas()
    v = v.astype(float)
    hits = sum(len(set(brute(np.arange(80_000), v, v[own], own)[0]) & set(g.vec_id)) for own, g in found.groupby("query_id"))
    assert found.query_id.nunique() == 100 and hits >= 0.95 * 2000


def test_defined_cases(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [0.5, 0.5], 1), (1, [0.0, 1.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, None], 1), (6, [float("inf"), 1.0], 1), (7, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (40, None, 1), (1, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = multi_index.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in out) == [(0, 1, 20, 0.5), (0, 2, 1, 0.0), (0, 3, 1, 0.0), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 1, 0.5)]
    assert multi_index.nearest(df.limit(0), df.limit(0)).count() == 0
    clash = df.selectExpr("*", *[f"1 AS {c}" for c in ("block", "asks", "v", "d", "a", "b", "query_id", "rank", "score")])
    again = multi_index.nearest(clash, clash.filter("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, out))
