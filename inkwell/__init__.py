"""A Spark engine that discovers, cleans, scores and fairly ranks written content."""
