"""operators of the postings engine."""
