"""wayfold: analytics over GPS activities as Spark DataFrame jobs."""
