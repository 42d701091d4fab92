"""operators of vigilframe."""
