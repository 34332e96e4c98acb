"""Operators: functions of DataFrames that return DataFrames, over the canonical views of ``model``."""
