"""Versioned, copy-on-write tables for machine-learning data, run on Spark."""
