"""Outreach and agent-operations analytics on Spark DataFrames and streams."""
