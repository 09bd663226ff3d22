"""Document-capture catalogue and training-data operations on Spark DataFrames."""
