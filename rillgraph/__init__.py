"""A Spark-native engine for dependency and lineage graphs."""
