"""Log analytics and corpus processing on Spark."""
