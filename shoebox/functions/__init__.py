"""Functions of the media-index engine."""
