"""Compositional count analysis on Spark: clean, roll up, filter, de-bias and compare."""
