"""Column builders for names, bands, credentials and paths."""
