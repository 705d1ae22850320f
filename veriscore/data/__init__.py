"""Data files of the package."""
