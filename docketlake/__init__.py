"""Review-corpus analytics on Spark."""
