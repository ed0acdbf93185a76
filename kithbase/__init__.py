"""kithbase: people-record queries, matching and synchronisation on Spark DataFrames."""
