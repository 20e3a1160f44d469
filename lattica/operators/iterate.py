"""Iteration: aggregates that ask for another round, and state that is transformed step by step."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; on one machine, where none is named, one beside the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir names no folder that the cluster shares")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints-{uuid.uuid4().hex}"


def cut(df: DataFrame, every: bool = True) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the folder that the cluster shares."""
    if not every:
        return df
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def iterate_aggregate(df: DataFrame, state: Any, step: Callable[[DataFrame, Any], Any], again: Callable[[Any, Any, int], bool], max_rounds: int = 100) -> tuple[Any, int]:
    """Rounds of ``step(df, state) -> state``, each of which aggregates the same input, while ``again`` says so.

    The state is a small value such as coefficients; the input is kept between rounds.
    """
    df = df.persist()
    try:
        for n in range(1, max_rounds + 1):
            new = step(df, state)
            more = again(state, new, n)
            state = new
            if not more:
                break
        return state, n
    finally:
        df.unpersist()


def iterate_state(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame, int], bool], max_rounds: int = 50, checkpoint_every: int = 1, keep_rounds: bool = False) -> DataFrame:
    """Rounds of ``step(state, round) -> state`` until ``done(old, new, round)``; the last state, or all with ``round``.

    ``done`` is where the convergence aggregate goes: it may run any aggregate over both states.
    """
    rounds = []
    for n in range(1, max_rounds + 1):
        new = cut(step(state, n), n % checkpoint_every == 0)
        if keep_rounds:
            rounds.append(new.withColumn("round", F.lit(n)))
        over = done(state, new, n)
        state = new
        if over:
            break
    return reduce(DataFrame.unionByName, rounds) if keep_rounds else state


def iterate_groups(df: DataFrame, keys: list[str], first: dict[str, Column], step: dict[str, Column], again: Column | None = None, max_rounds: int = 20) -> DataFrame:
    """Rounds of an aggregate within each group, which sees its group's state of the round before as columns.

    ``first`` aggregates the opening state of each group, ``step`` the next one, from the rows and the state's columns.
    A group goes on while ``again`` holds, a test of the new state (as named) against the old (``old_`` before the
    name); without it, all groups take ``max_rounds``. The state is a frame with one row for each group; every round is
    one join and one aggregate, for the groups that go on alone.
    """
    names = list(first)
    df = df.persist()
    try:
        state = df.groupBy(*keys).agg(*[c.alias(n) for n, c in first.items()])
        done = None
        for _ in range(max_rounds):
            state = cut(state)
            new = df.join(state, keys).groupBy(*keys).agg(*[c.alias(f"__{n}") for n, c in step.items()])
            both = new.join(state.withColumnsRenamed({n: f"old_{n}" for n in names}), keys).withColumnsRenamed({f"__{n}": n for n in names})
            if again is None:
                state = both.select(*keys, *names)
                continue
            both = cut(both.withColumn("__again", F.coalesce(again, F.lit(False))))
            over = both.filter("not __again").select(*keys, *names)
            done = over if done is None else done.unionByName(over)
            state = both.filter("__again").select(*keys, *names)
            if state.isEmpty():
                break
        state = cut(state)
        return state if done is None else done.unionByName(state)
    finally:
        df.unpersist()


def halt_after(rounds: int) -> Callable[[Any, Any, int], bool]:
    """Convergence rule: stop after so many rounds."""
    return lambda old, new, n: n >= rounds


def range_tasks(spark: SparkSession, begin: int, end: int, tasks: int) -> DataFrame:
    """(task, begin, end) work units that cover [begin, end)."""
    size = -(-(end - begin) // max(1, tasks))
    t = spark.range(tasks).withColumnRenamed("id", "task")
    return t.select("task", F.least(F.lit(end), begin + F.col("task") * size).alias("begin"), F.least(F.lit(end), begin + (F.col("task") + 1) * size).alias("end")).filter("begin < end")


def logistic_regression(df: DataFrame, x: list[str], y: str, rounds: int = 5) -> np.ndarray:
    """Coefficients for labels -1 and 1 by iteratively reweighted least squares; each round is one aggregate."""
    k = len(x)

    def step(rows: DataFrame, coef: np.ndarray) -> np.ndarray:
        eta = reduce(lambda a, b: a + b, [F.col(c) * float(w) for c, w in zip(x, coef, strict=True)])
        p = 1 / (1 + F.exp(-eta))
        a = p * (1 - p)
        target = a * eta + (F.when(F.col(y) > 0, 1.0).otherwise(0.0) - p)
        sums = [F.sum(F.col(x[i]) * F.col(x[j]) * a) for i in range(k) for j in range(i, k)] + [F.sum(F.col(c) * target) for c in x]
        got = list(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
        left, at = np.zeros((k, k)), 0
        for i in range(k):
            for j in range(i, k):
                left[i, j] = left[j, i] = got[at]
                at += 1
        return np.linalg.solve(left + 1e-9 * np.eye(k), np.array(got[at:], float))

    return iterate_aggregate(df, np.zeros(k), step, lambda old, new, n: n < rounds, rounds)[0]


def k_means(df: DataFrame, x: list[str], centers: list[list[float]], rounds: int = 10, tolerance: float = 1e-6) -> tuple[list[list[float]], int]:
    """Lloyd's rounds from given centres; each round is one aggregate by nearest centre. An empty centre stays."""

    def nearest(rows: DataFrame, c: list[list[float]]) -> DataFrame:
        gap = [reduce(lambda a, b: a + b, [(F.col(n) - v) * (F.col(n) - v) for n, v in zip(x, own, strict=True)]) for own in c]
        least = F.least(*gap) if len(gap) > 1 else gap[0]
        pick = F.lit(len(c) - 1)
        for i in range(len(c) - 2, -1, -1):
            pick = F.when(gap[i] == least, i).otherwise(pick)
        return rows.withColumn("center", pick)

    def step(rows: DataFrame, c: list[list[float]]) -> list[list[float]]:
        got = {r["center"]: [r[n] for n in x] for r in nearest(rows, c).groupBy("center").agg(*[F.avg(n).alias(n) for n in x]).collect()}
        return [got.get(i, own) for i, own in enumerate(c)]

    moved = lambda old, new, n: max(abs(a - b) for p, q in zip(old, new, strict=True) for a, b in zip(p, q, strict=True)) > tolerance
    return iterate_aggregate(df, centers, step, moved, rounds)
