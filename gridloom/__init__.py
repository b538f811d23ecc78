"""A PySpark-native analytics engine for constraint-elimination word games and the data built around them."""
