"""Point-in-time decision analytics as Spark DataFrame jobs."""
