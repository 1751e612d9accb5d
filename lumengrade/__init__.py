"""A PySpark-native engine for exam grading tables."""
