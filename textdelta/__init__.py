"""textdelta: a PySpark-native engine that analyses how texts change."""
