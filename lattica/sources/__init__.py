"""Sources and sinks."""

from lattica.sources import csv, generators, sinks, tables

__all__ = ["csv", "generators", "sinks", "tables"]
