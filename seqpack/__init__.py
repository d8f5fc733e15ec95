"""Spark-native engine for symbol sequences and quantized vector history."""
