"""A catalog analytics and similarity engine on PySpark DataFrames."""
