"""Streaming of the media-index engine."""
