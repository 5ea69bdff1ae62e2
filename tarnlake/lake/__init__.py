"""Keyed and append tables as Parquet change logs, and the jobs that maintain them."""

from tarnlake.lake.table import LakeTable

__all__ = ["LakeTable"]
