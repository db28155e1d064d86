"""inkwell: document analytics expressed as Spark DataFrames."""
