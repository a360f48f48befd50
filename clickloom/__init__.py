"""clickloom: a PySpark-native analytics engine."""
