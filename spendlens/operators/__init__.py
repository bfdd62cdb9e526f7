"""Named analyses: every function maps DataFrames to a DataFrame and starts no job."""
