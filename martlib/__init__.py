"""Warehouse and lakehouse operators for Spark: functions from DataFrame to DataFrame."""
