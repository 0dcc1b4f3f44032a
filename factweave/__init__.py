"""factweave: turn large streams of short documents into deduplicated, scored event records on Spark.

Every operator is a function from DataFrames (or Columns) to a DataFrame (or Column).
"Now" is always an argument, thresholds and term lists are parameters.
"""
