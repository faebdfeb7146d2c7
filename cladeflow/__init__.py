"""Coverage-informed taxonomic profiling and large-table data processing on Spark DataFrames."""

__version__ = "0.1.0"
