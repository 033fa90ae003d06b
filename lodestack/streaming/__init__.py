"""streaming of the postings engine."""
