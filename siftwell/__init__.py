"""Sensitive-data scanning, masking and training-data preparation on Spark."""
