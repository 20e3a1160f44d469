"""Relational, aggregate, transforming and iterative operators over DataFrames."""

from lattica.operators import aggregates, filters, iterate, joins, ranking, transforms

__all__ = ["aggregates", "filters", "iterate", "joins", "ranking", "transforms"]
