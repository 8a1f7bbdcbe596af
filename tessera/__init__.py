"""Tessera: episode analytics and corpus preparation on Spark DataFrames."""
