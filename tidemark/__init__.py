"""Review and demand analytics for many products at once, as Spark jobs."""
