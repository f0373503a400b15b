"""Plans of the media-index engine."""
