"""tenure: Spark-native analysis of large collections of career documents."""
