"""Composite queries over normalised events and samples."""
