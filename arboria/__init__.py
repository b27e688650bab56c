"""A PySpark-native code-graph analytics engine."""
