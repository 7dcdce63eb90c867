"""Spark-native analytics over company filings and other evidence-bearing tables."""
