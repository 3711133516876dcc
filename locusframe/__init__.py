"""Spark-native operators over genome-annotation tables and other row data."""
