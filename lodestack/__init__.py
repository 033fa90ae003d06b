"""lodestack: a Spark-native analytics engine for job postings and text corpora."""
