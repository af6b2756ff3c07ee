"""Retail sales, margin and customer-value analysis expressed as Spark DataFrames."""
