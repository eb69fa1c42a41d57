"""Sales pivot, enrichment and maintenance operators on Spark DataFrames."""
