"""Table operators: functions from DataFrames to DataFrames, with key and time columns as parameters."""
