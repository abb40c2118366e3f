"""Reports, loads and dimension upkeep as functions from DataFrames to DataFrames."""
