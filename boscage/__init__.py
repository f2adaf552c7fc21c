"""Point-cloud and tree-model analytics expressed over Spark DataFrames."""

__version__ = "0.1.0"
