"""quire: document analytics on Spark, written with DataFrames, SQL and windows."""
