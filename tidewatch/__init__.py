"""Tidewatch: one-way telemetry analytics on Spark DataFrames."""
