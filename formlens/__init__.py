"""Spark-native statistical shape analysis of 3-D binary masks."""
