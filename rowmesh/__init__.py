"""A Spark-native engine for message-style analytics: collectives, scans, sorts, graphs and sparse algebra as DataFrames."""
