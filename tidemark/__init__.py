"""A time-series and event analytics engine on PySpark DataFrames."""
