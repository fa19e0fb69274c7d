"""Operators: functions from DataFrames to DataFrames, no actions unless stated."""
