"""Expressions of the pipeline language as Spark columns."""
