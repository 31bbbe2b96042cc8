"""Readers of retail CSV files and of the driver tables."""
