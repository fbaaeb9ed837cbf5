"""Sources of source text and the store of spaces."""
