"""Streaming runs of the jobs."""
