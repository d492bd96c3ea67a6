"""A PySpark-native record-store analytics engine."""
