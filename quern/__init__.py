"""Document-pipeline analytics on Spark."""
