"""Artifacts and read-side queries built from the operators."""
