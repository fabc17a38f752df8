"""Evidence and ordered-sequence analytics written as PySpark DataFrame jobs."""
