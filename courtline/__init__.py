"""Spark-native analytics for rally-based team sports and ordered event logs."""
