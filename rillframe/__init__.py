"""Sensor-sequence analytics on Spark DataFrames."""
