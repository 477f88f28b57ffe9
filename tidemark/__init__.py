"""Analytics over content-addressed snapshot data, on Spark DataFrames."""
