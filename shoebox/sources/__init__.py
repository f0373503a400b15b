"""Sources of the media-index engine."""
