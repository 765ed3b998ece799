"""Order ingestion and table landing on Spark."""
