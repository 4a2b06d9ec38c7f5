"""Retrieval, graph, evaluation and corpus operators over DataFrames."""
