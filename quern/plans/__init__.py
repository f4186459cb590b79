"""Pipelines as data: parsing, policy, analysis and rewriting. Nothing here touches Spark."""
