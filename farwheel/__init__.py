"""Transit analytics on Spark."""
