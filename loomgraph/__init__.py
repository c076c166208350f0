"""Knowledge graphs from text, as Spark DataFrame jobs."""
