"""A Spark-native engine for a compact SQL dialect: typed catalog, CNF predicates, SUM."""
