"""Operators of the media-index engine."""
