"""Keeping an index up to date from a stream of sources."""
