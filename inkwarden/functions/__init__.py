"""Building blocks; see README."""
