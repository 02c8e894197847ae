"""tideline: analytics and data-processing operators on Spark DataFrames."""
