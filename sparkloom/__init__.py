"""Spark-native analytics over code, history, session and document facts."""
