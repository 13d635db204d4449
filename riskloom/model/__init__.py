"""Sampling, training, validation and scoring on Spark ML."""
