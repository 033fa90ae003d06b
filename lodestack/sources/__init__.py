"""sources of the postings engine."""
