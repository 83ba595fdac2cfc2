"""A PySpark-native analytics engine for daily market time series."""
