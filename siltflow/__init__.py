"""Signal and corpus analytics on Spark."""
