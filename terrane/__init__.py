"""Spark-native analytics for geospatial scenes, access networks and evaluation runs."""
