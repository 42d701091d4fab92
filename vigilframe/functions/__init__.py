"""functions of vigilframe."""
