"""Sources: files, parsers, the corpus manifest."""
