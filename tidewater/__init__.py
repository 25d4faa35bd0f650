"""tidewater: time-series risk analytics on Spark DataFrames."""
