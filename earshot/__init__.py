"""Listening-event analytics, graph features and training-data operators on Spark."""
