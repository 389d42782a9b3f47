"""A Spark-native engine for cataloguing and analysing large collections of spatial and tabular data."""
