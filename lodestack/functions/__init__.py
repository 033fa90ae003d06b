"""functions of the postings engine."""
