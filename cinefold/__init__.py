"""Spark-native analytics over frame sequences, trajectories and tracks."""
