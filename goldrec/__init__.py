"""Golden customer records on Spark: batch and streaming jobs."""
