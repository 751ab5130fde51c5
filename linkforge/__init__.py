"""Link analysis, entity resolution and report search on Spark DataFrames."""
