"""Text-privacy and corpus operators for Spark DataFrames."""
