"""Checkpoint telemetry and run analytics on Spark DataFrames and Structured Streaming."""
