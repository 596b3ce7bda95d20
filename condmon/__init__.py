"""PySpark-native condition-monitoring analytics."""
