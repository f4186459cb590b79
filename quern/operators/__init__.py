"""Stages of the pipeline language as DataFrame operations."""
