"""Text-guard analytics for Spark DataFrames."""
