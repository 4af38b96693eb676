"""Event analytics over recordings as Spark jobs."""
