"""Evidence-carrying numbers, portfolio risk and document checks on Spark DataFrames."""

__version__ = "0.1.0"
