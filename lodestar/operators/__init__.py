"""Graph operators on (src, dst) DataFrames."""
