"""Sales analytics as Spark DataFrame jobs: audit, clean, load, verify and query."""
