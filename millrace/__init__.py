"""Millrace: Spark-native document ingestion, quality and conversation analytics."""
