"""Event-stream analytics on Spark."""
