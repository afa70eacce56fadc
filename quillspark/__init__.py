"""Document retrieval and text analytics on PySpark DataFrames."""
