"""Domain results. Each function takes DataFrames and parameters and returns a DataFrame."""
