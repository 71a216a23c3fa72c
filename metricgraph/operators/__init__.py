"""The operators: functions of DataFrames that return DataFrames, lazy unless they iterate."""
