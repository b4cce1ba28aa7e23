"""Trial and session analytics for event-locked time series, on Spark DataFrames."""
