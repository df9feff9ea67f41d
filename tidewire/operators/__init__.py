"""Reusable operators built from DataFrame operations."""
