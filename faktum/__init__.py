"""Facts about files and text records, as Spark DataFrames."""
