"""Quernstone: evidence warehousing, pair benchmarks and training-data operators on PySpark DataFrames."""
