"""Sales and order analytics for a manufacturer's star schema, on Spark DataFrames."""
