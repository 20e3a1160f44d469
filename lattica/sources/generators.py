"""Generated rows: clusters with a distribution for each column."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parameters of each distribution, in order.
DISTRIBUTIONS = {
    "uniform": ("low", "high"),
    "normal": ("mean", "deviation"),
    "gaussian": ("mean", "deviation"),
    "exponential": ("rate",),
    "inverse_gaussian": ("mean", "shape"),
    "binomial": ("n", "p"),
    "negative_binomial": ("n", "p"),
    "gamma": ("shape", "scale"),
}
#: Parameters that a program leaves out.
DEFAULTS = {
    "uniform": (0.0, 1.0),
    "normal": (0.0, 1.0),
    "gaussian": (0.0, 1.0),
    "exponential": (1.0,),
    "inverse_gaussian": (1.0, 1.0),
    "binomial": (1.0, 0.5),
    "negative_binomial": (1.0, 0.5),
    "gamma": (1.0, 1.0),
}
_NATIVE = ("uniform", "normal", "gaussian", "exponential", "inverse_gaussian")


@dataclass(frozen=True)
class Spread:
    """A distribution by name with its parameters."""

    name: str
    parameters: tuple[float, ...]

    def __post_init__(self) -> None:
        if len(self.parameters) != len(DISTRIBUTIONS.get(self.name, ())) or self.name not in DISTRIBUTIONS:
            raise ValueError(f"unknown distribution or parameters: {self.name}{self.parameters}")

    def column(self, z: Column, u: Column) -> Column:
        """A value from a normal draw z and a uniform draw u, which must be columns of their own."""
        a = self.parameters
        if self.name == "uniform":
            return a[0] + u * (a[1] - a[0])
        if self.name in ("normal", "gaussian"):
            return a[0] + z * a[1]
        if self.name == "exponential":
            return -F.log(1 - u) / a[0]
        return inverse_gaussian(a[0], a[1], z, u)

    def sample(self, rng: np.random.Generator, n: int) -> np.ndarray:
        a = self.parameters
        draw = {
            "uniform": lambda: rng.uniform(a[0], a[1], n),
            "normal": lambda: rng.normal(a[0], a[1], n),
            "gaussian": lambda: rng.normal(a[0], a[1], n),
            "exponential": lambda: rng.exponential(1 / a[0], n),
            "inverse_gaussian": lambda: rng.wald(a[0], a[1], n),
            "binomial": lambda: rng.binomial(int(a[0]), a[1], n).astype(float),
            "negative_binomial": lambda: rng.negative_binomial(a[0], a[1], n).astype(float),
            "gamma": lambda: rng.gamma(a[0], a[1], n),
        }
        return draw[self.name]()


def inverse_gaussian(mean: float, shape: float, z: Column, u: Column) -> Column:
    """Transformation with multiple roots: the smaller root of a chi-square draw, or its counterpart."""
    y = z * z
    root = mean + mean * mean * y / (2 * shape) - mean / (2 * shape) * F.sqrt(4 * mean * shape * y + mean * mean * y * y)
    return F.when(u <= mean / (mean + root), root).otherwise(mean * mean / root)


def clusters(spark: SparkSession, n: int, centers: list[list[Spread]], names: list[str], seed: int = 0, tasks: int | None = None, with_center: str | None = None) -> DataFrame:
    """n rows for each task, each from one of the centres, with one distribution for each column.

    Distributions that Spark can express stay columns; others are drawn by numpy in batches.
    """
    if any(len(c) != len(names) for c in centers):
        raise ValueError("every centre needs a distribution for each column")
    tasks = tasks or 1
    rows = spark.range(0, n * tasks, 1, tasks).withColumn("__c", F.floor(F.rand(seed) * len(centers)).cast("int"))
    if all(s.name in _NATIVE for c in centers for s in c):
        # draws are columns of their own: inside a condition, a generator would fall out of step
        drawn = rows.withColumns({f"__{k}{j}": f(seed + 7919 * j + i + 1) for j in range(len(names)) for i, (k, f) in enumerate((("z", F.randn), ("u", F.rand)))})
        cols = {}
        for j, name in enumerate(names):
            own = [c[j].column(F.col(f"__z{j}"), F.col(f"__u{j}")) for c in centers]
            value = own[-1]
            for i in range(len(centers) - 2, -1, -1):
                value = F.when(F.col("__c") == i, own[i]).otherwise(value)
            cols[name] = value
        out = drawn.withColumns(cols)
    else:

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                rng = np.random.default_rng([seed, int(pdf["id"].iloc[0])])
                for j, name in enumerate(names):
                    value = np.zeros(len(pdf))
                    for i, c in enumerate(centers):
                        mine = (pdf["__c"] == i).to_numpy()
                        value[mine] = c[j].sample(rng, int(mine.sum()))
                    pdf[name] = value
                yield pdf

        out = rows.mapInPandas(draw, "id long, __c int, " + ", ".join(f"`{c}` double" for c in names))
    return out.select(*([F.col("__c").alias(with_center)] if with_center else []), *names)


def expected_mean(s: Spread) -> float:
    """Mean of a distribution, for checks."""
    a = s.parameters
    return {
        "uniform": lambda: (a[0] + a[1]) / 2,
        "exponential": lambda: 1 / a[0],
        "binomial": lambda: a[0] * a[1],
        "negative_binomial": lambda: a[0] * (1 - a[1]) / a[1],
        "gamma": lambda: a[0] * a[1],
    }.get(s.name, lambda: math.fsum(a[:1]))()
