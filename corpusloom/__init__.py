"""corpusloom: document-knowledge analytics as PySpark DataFrame jobs."""
