"""Column-level helpers: dynamic-JSON coercions, time and rate text, proxy text."""
