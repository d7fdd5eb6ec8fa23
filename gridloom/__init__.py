"""A Spark-native store and query engine for simulation time series."""
