"""paragraf: citation retrieval, citation graphs and corpus preparation on Spark DataFrames."""
