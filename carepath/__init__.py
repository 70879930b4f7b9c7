"""Patient-journey claims analytics as Spark DataFrame jobs."""
