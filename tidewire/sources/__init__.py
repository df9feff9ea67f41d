"""Readers that give normalised DataFrames with the run keys as columns."""
