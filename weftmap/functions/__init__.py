"""Column functions for paths and text, and the extractors of definitions."""
