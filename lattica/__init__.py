"""Analytics engine on PySpark DataFrames."""
