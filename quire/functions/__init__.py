"""Part of quire; see README.md."""
