"""quoin: editorial-quality and corpus analytics as PySpark DataFrame jobs."""
