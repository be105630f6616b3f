"""PySpark-native analytics for cell-type-resolved interaction networks."""
