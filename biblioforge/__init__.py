"""Batch verification of bibliographic references on Spark, and training-data operators."""
