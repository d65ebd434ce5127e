"""Readers and writers for cubes, frames, labels, models and result tables."""
