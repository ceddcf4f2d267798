"""Graph memory analytics and corpus preparation on PySpark DataFrames."""
