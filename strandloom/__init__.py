"""strandloom: bidirected sequence graphs and corpus preparation on Spark DataFrames."""
