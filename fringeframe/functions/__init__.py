"""Column builders: array arithmetic, hash draws, distribution helpers."""
