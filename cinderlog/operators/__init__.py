"""DataFrame operators of the log and retrieval paths."""
