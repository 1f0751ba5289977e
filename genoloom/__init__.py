"""Spark-native analytics: genetics joined with spatial transcriptomics."""
