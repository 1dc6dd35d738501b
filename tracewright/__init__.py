"""Developer-workflow analytics on Spark."""
