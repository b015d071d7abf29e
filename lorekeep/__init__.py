"""Memory-store analytics and corpus preparation as Spark jobs."""
