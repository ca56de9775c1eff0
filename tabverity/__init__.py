"""Evaluation of synthetic tables on Spark."""
