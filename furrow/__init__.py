"""Crop-stress analytics as plain PySpark DataFrame functions."""
