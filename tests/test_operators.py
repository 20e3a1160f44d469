"""Edge cases on literal tables."""

from __future__ import annotations

import numpy as np
import pytest
from literal_rows import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.operators import aggregates as agg
from lattica.operators import filters, iterate, joins, ranking, transforms


def test_empty_input(spark):
    df = spark.createDataFrame([], "a int, x double")
    assert rows(agg.evaluate(df, agg.sums({"s": "a", "t": "x"}))) == [(0, 0.0)]
    assert rows(agg.evaluate(df, agg.sums({"s": "a"}, zero_if_empty=False))) == [(None,)]
    assert rows(agg.evaluate(df, agg.count())) == [(0,)]
    assert rows(agg.evaluate(df, agg.minima({"m": "a"}))) == [(None,)]
    assert rows(agg.evaluate(df, agg.linear_counting(["a"]))) == [(0.0,)]
    assert rows(ranking.extreme_tuples(df, {"a": "MAX"})) == []


def test_ties(spark):
    df = spark.createDataFrame([(5, 1), (5, 2), (4, 3), (5, 4)], "score int, id int")
    assert rows(ranking.top_k(df, "score", 2, ["id"])) == [(5, 1), (5, 2)]
    assert rows(ranking.extreme_tuples(df, {"score": "MAX"})) == [(5, 1), (5, 2), (5, 4)]
    assert rows(ranking.extreme_tuples(df, {"score": "MIN", "id": "MAX"})) == [(4, 3)]
    ranked = ranking.order_by(df, {"score": "DESC", "id": "DESC"}, rank="r")
    assert rows(ranked) == [(4, 3, 4), (5, 1, 3), (5, 2, 2), (5, 4, 1)]
    assert rows(ranking.order_by(df, {"score": "DESC", "id": "ASC"}, limit=2, rank="r")) == [(5, 1, 1), (5, 2, 2)]


def test_nulls(spark):
    df = spark.createDataFrame([(None, "x"), (1, None), (1, "x"), (None, "x")], "a int, b string")
    assert agg.evaluate(df, agg.count_distinct(["a", "b"])).first()[0] == 3
    assert agg.evaluate(df, agg.count_distinct(["a", "b"], null_check=True)).first()[0] == 1
    assert agg.evaluate(df, agg.distinct(["a", "b"])).count() == 3
    assert agg.evaluate(df, agg.distinct(["a", "b"], null_check=["a"])).count() == 2
    assert joins.inner(df, ["a"], df.toDF("c", "d"), ["c"]).count() == 4
    assert joins.inner(df, ["a"], df.toDF("c", "d"), ["c"], null_safe=True).count() == 8


def test_closed_intervals(spark):
    bands = spark.createDataFrame([(0, 10, "a"), (11, 20, "b"), (9, 3, "never")], "lo int, hi int, tag string")
    points = spark.createDataFrame([(0,), (10,), (11,), (20,), (21,)], "v int")
    for width in (1.0, 7.0, 100.0):
        out = joins.interval_join(points, "v", bands, "lo", "hi", width).select("v", "tag")
        assert rows(out) == [(0, "a"), (10, "a"), (11, "b"), (20, "b")]
        kept = joins.interval_join(points, "v", bands, "lo", "hi", width, keep_missing=True).select("v", "tag")
        assert (21, None) in rows(kept)
        assert kept.count() == 5


def test_half_open_keyed_intervals(spark):
    bands = spark.createDataFrame([("k", 0, 10, "a"), ("k", 10, 20, "b")], "k string, lo int, hi int, tag string")
    points = spark.createDataFrame([("k", 0), ("k", 10), ("k", 20), ("other", 5)], "pk string, v int")
    for width in (None, 4.0):
        assert rows(joins.group_interval_join(points, ["pk"], "v", bands, ["k"], "lo", "hi", width).select("v", "tag")) == [(0, "a"), (10, "b")]
        kept = rows(joins.group_interval_join(points, ["pk"], "v", bands, ["k"], "lo", "hi", width, keep_missing=True).select("pk", "v", "tag"))
        assert kept == [("k", 0, "a"), ("k", 10, "b"), ("k", 20, None)]


def test_many_keyed_intervals_meet_in_bins(spark):
    """A key with many intervals has them in bins of their lengths; keys with few, and endless intervals, in one."""
    endless = float("inf")
    data = [("k", float(i), i + 2.0) for i in range(60)] + [("k", 10.0, 50.5), ("k", 58.0, endless), ("one", -endless, endless), ("one", 3.0, 3.0)]
    bands = spark.createDataFrame(data, "k string, lo double, hi double")
    points = spark.createDataFrame([("k", v / 4) for v in range(-4, 260)] + [("k", endless), ("k", None), ("one", 7.0), ("one", 3.0), ("other", 5.0)], "pk string, v double")
    want = sorted(((p, v, lo) for p, v in points.collect() for k, lo, hi in data if p == k and v is not None and lo <= v < hi), key=repr)
    found = joins.group_interval_join(points, ["pk"], "v", bands, ["k"], "lo", "hi")
    assert "__bin" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(found.select("pk", "v", "lo")) == want
    kept = joins.group_interval_join(points, ["pk"], "v", bands, ["k"], "lo", "hi", keep_missing=True)
    assert rows(kept.filter("lo is not null").select("pk", "v", "lo")) == want
    assert rows(kept.filter("lo is null").select("pk", "v")) == rows(points.filter("pk = 'k' and (v is null or v < 0 or v = double('inf'))"))


@pytest.fixture
def unasked(spark):
    """Joins that nobody hinted at aren't broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_intervals_bring_no_values_together(spark, unasked):
    """Few intervals go to the values, on one level or several, as a value of many rows would fill a task."""
    points = spark.range(50).selectExpr("cast(id as double) v")
    for data in ([(1.0, 10.0), (11.0, 20.0)], [(1.0, 10.0), (21.0, 40.0)]):
        bands = spark.createDataFrame(data, "lo double, hi double")
        found = joins.interval_join(points, "v", bands, "lo", "hi", 10.0)
        assert "hashpartitioning" not in plan(found)
        assert rows(found) == sorted(((float(v), lo, hi) for v in range(50) for lo, hi in data if lo <= v <= hi), key=repr)


def test_values_kept_without_interval_stay_where_they_are(spark, unasked):
    points = spark.range(50).selectExpr("cast(id as double) v")
    for data in ([(1.0, 10.0), (11.0, 20.0)], [(1.0, 10.0), (21.0, 40.0)]):
        bands = spark.createDataFrame(data, "lo double, hi double")
        kept = joins.interval_join(points, "v", bands, "lo", "hi", 10.0, keep_missing=True)
        assert "hashpartitioning" not in plan(kept)
        met = [(float(v), lo, hi) for v in range(50) for lo, hi in data if lo <= v <= hi]
        assert rows(kept) == sorted(met + [(float(v), None, None) for v in range(50) if float(v) not in {m[0] for m in met}], key=repr)


def test_keyed_intervals_of_time(spark):
    for kind, text in (("timestamp", "2024-01-01 00:00:{:02}"), ("timestamp_ntz", "1969-12-31 23:{:02}:59.999999"), ("date", "2024-01-{:02}"), ("string", "{:02}")):
        at = lambda rows, names: spark.createDataFrame([("k", *[text.format(i) for i in r]) for r in rows], "k string, " + ", ".join(f"{n} string" for n in names)).selectExpr("k", *[f"cast({n} as {kind}) {n}" for n in names])  # noqa: E731, B023
        bands = at([(i, i + 2) for i in range(1, 20)] + [(5, 15)], ["lo", "hi"])
        points = at([(i,) for i in range(1, 25)], ["v"]).withColumnRenamed("k", "pk")
        same = bands.join(points, (F.col("pk") == F.col("k")) & (F.col("v") >= F.col("lo")) & (F.col("v") < F.col("hi")))
        found = joins.group_interval_join(points, ["pk"], "v", bands, ["k"], "lo", "hi")
        assert ("__bin" in plan(found)) == (kind != "string")
        assert rows(found.select("v", "lo", "hi")) == rows(same.select("v", "lo", "hi"))


def test_known_distinct(spark):
    df = spark.range(9).selectExpr("id % 3 k", "id v")
    assert joins.known_distinct(df.groupBy(F.col("k").alias("g")).agg(F.min("v").alias("lo")).filter("lo < 2"), ["g"])
    assert not joins.known_distinct(df.groupBy("k", "v").count(), ["k"])
    assert not joins.known_distinct(df, ["k"])


def test_duplicate_keys(spark):
    left = spark.createDataFrame([(1, "l1"), (1, "l2"), (2, "l3")], "a int, x string")
    right = spark.createDataFrame([(1, "r1"), (1, "r2"), (1, "r3")], "b int, y string")
    assert joins.inner(left, ["a"], right, ["b"]).count() == 6
    assert rows(joins.exists_in(left, ["a"], right, ["b"])) == [(1, "l1"), (1, "l2")]
    assert rows(joins.not_exists_in(left, ["a"], right, ["b"])) == [(2, "l3")]
    assert joins.left_outer(left, ["a"], right, ["b"]).count() == 7
    assert joins.with_state(left, ["a"], right, ["b"]).count() == 6


def test_as_of(spark):
    left = spark.createDataFrame([("k", 5), ("k", 1), ("z", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 2, "a"), ("k", 5, "b"), ("k", 6, "c")], "k string, u int, v string")
    assert rows(joins.as_of(left, right, ["k"], "t", "u", ["v"])) == [("k", 1, None), ("k", 5, "b"), ("z", 9, None)]


def test_runs(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 1), (3, "b", 1), (4, "a", 1)], "o int, k string, g int")
    out = transforms.runs(df, "k", agg.count("n"), ["o"], ["g"])
    assert rows(out.select("run", "k", "n")) == [(0, "a", 2), (1, "b", 1), (2, "a", 1)]


def test_ranges(spark):
    df = spark.createDataFrame([(10,)], "v int")
    assert rows(transforms.value_range(df, {"w": "v"}, -4, 2).select("w")) == [(10,), (6,), (8,)]
    assert rows(transforms.value_range(df, {"w": "v"}, 3, 2, 1).select("w")) == [(11,), (13,)]
    with pytest.raises(ValueError):
        transforms.value_range(df, {"w": "v"}, 0)
    two = spark.createDataFrame([(3, 1), (2, 2)], "a int, b int")
    assert rows(transforms.interval_to_discrete(two, "a", "b", "k").select("a", "k")) == [(2, 2), (3, 1), (3, 2), (3, 3)]
    assert rows(transforms.interval_to_discrete(two, "a", "b", "k", inclusive=False).select("a", "k")) == [(3, 1), (3, 2)]


def test_multiplex_of_uneven_parts(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "a int, b string")
    out = agg.evaluate(df, agg.multiplex([agg.distinct(["a"]), agg.distinct(["b"]), agg.count("n")]))
    assert rows(out.select("a", "b", "n")) == [(1, "x", 3), (2, "y", 3), (3, "y", 3)]


def test_filters(spark):
    df = spark.range(1000)
    assert filters.filter_by(df).count() == 1000
    assert filters.bernoulli(df, 0.0, 1, ["id"]).count() == 0
    assert filters.bernoulli(df, 1.0, 1, ["id"]).count() == 1000
    assert 400 < filters.bernoulli(df, 0.5, 1).count() < 600
    with pytest.raises(ValueError):
        filters.bernoulli(df, 2)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50)), min_size=1, max_size=30))
def test_partitioning_changes_nothing(spark, data):
    df = spark.createDataFrame(data, "k int, v int")
    user = agg.UserAggregate(lambda: 0, lambda s, x: s + x, lambda a, b: a + b, lambda s: [(s,)], ["v"], "total long")
    own = agg.group_by(["k"], user)
    one, seven = (agg.evaluate(df.repartition(n), own) for n in (1, 7))
    assert rows(one) == rows(seven) == rows(agg.evaluate(df, agg.group_by(["k"], agg.sums({"total": "v"}))))


def test_iteration(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = np.where(rng.random(400) < 1 / (1 + np.exp(-(0.5 + 2 * x))), 1, -1)
    df = spark.createDataFrame([(1.0, float(a), int(b)) for a, b in zip(x, y, strict=True)], "one double, x double, y int")
    w = np.zeros(2)
    m = np.stack([np.ones(400), x], axis=1)
    for _ in range(5):
        p = 1 / (1 + np.exp(-m @ w))
        a = p * (1 - p)
        w = np.linalg.solve((m * a[:, None]).T @ m, m.T @ (a * (m @ w) + (y > 0) - p))
    assert iterate.logistic_regression(df, ["one", "x"], "y") == pytest.approx(w, rel=1e-6)
    points = spark.createDataFrame([(float(v),) for v in [0, 1, 2, 10, 11, 12]], "x double")
    centers, _ = iterate.k_means(points, ["x"], [[0.0], [1.0]])
    assert sorted(c[0] for c in centers) == [1.0, 11.0]
    tasks = iterate.range_tasks(spark, 3, 20, 4)
    assert tasks.agg(F.min("begin"), F.max("end"), F.sum(F.col("end") - F.col("begin"))).first() == (3, 20, 17)
    rounds = iterate.iterate_state(spark.range(1), lambda s, n: s.select((F.col("id") + 1).alias("id")), lambda a, b, n: n == 3, keep_rounds=True)
    assert rounds.count() == 3
