"""Spark-native analytics for irregular personal telemetry."""
