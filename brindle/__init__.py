"""brindle: dataset compression and training-data operators on Spark DataFrames."""
