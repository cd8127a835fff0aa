"""PySpark-native analytics for irregular event data."""
