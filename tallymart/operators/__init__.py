"""One module per group of operators; each takes DataFrames and returns a DataFrame."""
