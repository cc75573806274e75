"""Network-based enrichment analysis and corpus processing on Spark DataFrames."""
