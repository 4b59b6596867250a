"""Evidence-first evaluation analytics on Spark."""
