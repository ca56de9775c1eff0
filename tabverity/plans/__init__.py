"""Evaluations of whole table sets."""
