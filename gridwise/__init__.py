"""Part of the gridwise library; see README.md."""
