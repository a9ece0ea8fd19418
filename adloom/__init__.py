"""Spark jobs that turn fetched job-board pages and chat messages into one clean table of ads."""
