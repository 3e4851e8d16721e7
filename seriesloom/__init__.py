"""Panel time-series features, targets, models and reports on Spark DataFrames."""
