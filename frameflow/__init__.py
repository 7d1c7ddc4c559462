"""PySpark-native analytics for episodes of time-ordered frames."""
