"""Splicing analytics on Spark: junction pooling, intron clusters, usage tests and corpus tools."""
