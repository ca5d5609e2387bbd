"""Document curation and pseudonymisation on Spark DataFrames."""
