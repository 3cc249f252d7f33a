"""Music-catalogue analytics on Spark DataFrames."""
