"""Evidence retrieval and answer auditing over document corpora, on Spark."""
