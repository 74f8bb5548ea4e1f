"""Exact network-distance queries over moving objects on road networks, and training-data operators, on Spark."""
