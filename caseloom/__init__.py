"""Case-record and training-corpus jobs on Spark DataFrames."""
