"""Document reconciliation and recounting on Spark DataFrames."""
