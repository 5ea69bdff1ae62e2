"""The named jobs: functions from DataFrames to a DataFrame, used in batch and on streams alike."""
