"""ragstone: retrieval analytics over text and embeddings as Spark DataFrames."""

__version__ = "0.1.0"
