"""strataflow: Spark-native trace analytics."""
