"""engram: an associative-memory and retrieval engine on Spark DataFrames."""
