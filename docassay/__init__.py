"""Document-record validation and corpus analytics, written for Spark."""
