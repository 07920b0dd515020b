"""Spark-native analytics over detections, tracks and match events."""
