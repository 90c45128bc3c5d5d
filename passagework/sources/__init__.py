"""Reading documents, and writing and reading the index."""
