"""quarry: code-and-document knowledge analytics as Spark DataFrame jobs."""
