"""Spark-native lakehouse analytics: contracts, history, joins, measures, quality, streams."""
