"""plans of vigilframe."""
