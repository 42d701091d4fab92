"""sources of vigilframe."""
