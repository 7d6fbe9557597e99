"""lodestrand: retrieval and code analytics on Spark DataFrames."""
