"""PySpark-native code- and graph-analytics engine."""
