"""Continuous loading of landed extracts."""
