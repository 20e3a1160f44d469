"""A small dataflow language that compiles to DataFrames."""

from lattica.plans.parser import parse
from lattica.plans.planner import Planner, run

__all__ = ["Planner", "parse", "run"]
