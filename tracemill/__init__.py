"""Spark jobs for reasoning-trace analytics and training-data preparation."""
