"""lodestar: graph traversal analytics and corpus operators on PySpark DataFrames."""
