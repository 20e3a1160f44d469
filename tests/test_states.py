"""States, iterations and what users add to the language."""

from __future__ import annotations

import pytest
from literal_rows import rows
from pyspark.sql import functions as F

from lattica.operators import aggregates as agg
from lattica.operators import iterate, joins, ranking
from lattica.plans import Planner
from lattica.plans.lexer import ProgramError


@pytest.fixture
def planner(spark):
    data = {
        "t": spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (3, "a", 3.5), (4, "z", 0.0)], "k int, s string, x double"),
        "u": spark.createDataFrame([("a", 10), ("a", 11), ("b", 20)], "name string, v int"),
    }
    return Planner(data.__getitem__)


def test_state_joins_give_every_match(planner):
    out = planner.run("""
        t = LOAD t; u = LOAD u;
        h = GLA:Multi_Hash<split = 1> FROM u USING name, v AS SELF;
        j = GT:Join FROM t REQUIRES h USING s AS v;
        l = GT:Join<keep.missing = true> FROM t REQUIRES h USING s AS v;
    """)
    assert rows(out["j"].select("k", "v")) == [(1, 10), (1, 11), (2, 20), (3, 10), (3, 11)]
    assert out["l"].filter("v is null").count() == 1
    assert planner.states["h"].keys == 1


def test_mistakes_are_named(planner):
    for source in ("g = GIST:Nothing AS x;", "t = LOAD t; h = GLA:Multi_Hash<split = 2> FROM t USING k, s, x AS SELF; j = GT:Join FROM t REQUIRES h USING k AS x;", "t = LOAD t; j = GT:Join FROM t REQUIRES none USING k AS x;", "g = READ USING GI:ClusterGen<n = 3> ATTRIBUTES x : DOUBLE;"):
        with pytest.raises(ProgramError):
            planner.run(source)
    with pytest.raises(ProgramError):
        planner.register_operator("<=>", lambda a, b: a)


def test_users_add_iterations(spark, planner):
    def closure(spark, states, rounds):
        step = lambda s, n: s.unionByName(s.selectExpr("k + 1 as k")).distinct()
        return iterate.iterate_state(states[0], step, iterate.halt_after(rounds), rounds)

    planner.iterations["Closure"] = closure
    out = planner.run("t = LOAD t; f = FILTER t BY k == 1; s = GLA:Gather FROM f USING k AS SELF; g = GIST:Closure<rounds = 3> REQUIRES s AS n : BIGINT;")
    assert rows(out["g"]) == [(1,), (2,), (3,), (4,)]


def test_users_add_iterable_aggregates(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "x double")
    root = agg.iterable(1.0, lambda d, s: (s + d.agg(F.sum("x")).first()[0] / s) / 2, lambda old, new, n: abs(old - new) > 1e-9, lambda s: [(s,)], "r double")
    assert agg.evaluate(df, root).first().r == pytest.approx(4.0)


def test_groups_iterate_until_each_is_done(spark):
    """Halving until at most 1: groups need different numbers of rounds."""
    df = spark.createDataFrame([("a", 16.0), ("b", 1.0), ("c", 5.0)], "g string, x double")
    first = {"v": F.max("x"), "n": F.lit(0)}
    step = {"v": F.max(F.col("v") / 2), "n": F.max(F.col("n") + 1)}
    out = iterate.iterate_groups(df, ["g"], first, step, again=F.col("v") > 1)
    assert rows(out.select("g", "v", "n")) == [("a", 1.0, 4), ("b", 0.5, 1), ("c", 0.625, 3)]


def test_long_intervals_on_levels(spark):
    spans = spark.createDataFrame([(0, 100_000, "long"), (5, 6, "short"), (7, 3, "empty"), (90, 130, "mid")], "lo int, hi int, n string")
    points = spark.createDataFrame([(5,), (100,), (100_001,), (None,)], "p int")
    found = joins.interval_join(points, "p", spans, "lo", "hi", 1.0, keep_missing=True)
    assert rows(found.select("p", "n")) == [(100, "long"), (100, "mid"), (100_001, None), (5, "long"), (5, "short"), (None, None)]


def test_as_of_across_buckets(spark):
    t = lambda s: f"2024-01-01 {s}"
    left = spark.createDataFrame([(1, "k", t("00:00:05")), (2, "k", t("03:00:00")), (3, "k", t("09:00:00")), (4, "other", t("09:00:00"))], "i int, key string, at string").withColumn("at", F.col("at").cast("timestamp"))
    right = spark.createDataFrame([("k", t("00:00:10"), 7), ("k", t("02:59:59"), 8), ("k", t("03:00:00"), 9)], "key string, then string, v int").withColumn("then", F.col("then").cast("timestamp"))
    for bucket in (None, 3600, 10):
        found = joins.as_of(left, right, ["key"], "at", "then", ["v"], bucket)
        assert rows(found.select("i", "v")) == [(1, None), (2, 9), (3, 9), (4, None)]


def test_ties_at_the_limit(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 5), (4, 9)], "k int, v int")
    assert rows(ranking.order_by(df, {"v": "DESC"}, 2, keep_ties=True)) == [(1, 5), (4, 9)]
    assert rows(ranking.order_by(df, {"v": "DESC"}, 2, keep_ties=False)) == [(3, 5), (4, 9)]


def test_multiplexed_rows_without_keys(spark):
    df = spark.createDataFrame([(i % 3, i % 5) for i in range(15)], "a int, b int")
    out = agg.evaluate(df, agg.multiplex([agg.distinct(["a"]), agg.distinct(["b"])]))
    assert rows(out.select("a", "b")) == [(0, 0), (1, 1), (2, 2), (2, 3), (2, 4)]
