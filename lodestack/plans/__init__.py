"""plans of the postings engine."""
