"""Text-privacy and training-data analytics on Spark DataFrames."""
