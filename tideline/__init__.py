"""Spark-native analytics for ordered, persisted market-event logs."""
