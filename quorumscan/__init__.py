"""Windows with at least X distinct subjects, and what leads up to them, on Spark DataFrames."""
