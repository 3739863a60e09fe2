"""Evidence-driven notice intelligence on Spark DataFrames."""
