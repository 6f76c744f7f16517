"""Radio-navigation data engineering and route planning on Spark DataFrames."""
