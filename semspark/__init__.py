"""semspark: a PySpark-native semantic analytics engine."""
