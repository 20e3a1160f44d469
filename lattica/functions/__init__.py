"""Scalar functions as Column builders; all of them stay inside code generation."""

from lattica.functions import arrays, categories, dates, geo, maths, network, text

__all__ = ["arrays", "categories", "dates", "geo", "maths", "network", "text"]
