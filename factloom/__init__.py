"""A Spark-native engine for fact tables drawn from documents."""
