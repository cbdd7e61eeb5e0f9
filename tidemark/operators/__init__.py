"""Operators: functions from DataFrames to DataFrames, grouped by ``app_id``."""
