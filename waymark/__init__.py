"""Waymark: convergence of web entry points, declared on Spark DataFrames."""
