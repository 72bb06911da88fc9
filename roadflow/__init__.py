"""roadflow: road-sensor analytics as Spark DataFrame jobs."""
