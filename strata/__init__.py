"""strata: versioned, ordered key-value data as Spark DataFrames."""
