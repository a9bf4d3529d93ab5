"""citeloom: passage-citation analytics on Spark DataFrames."""
