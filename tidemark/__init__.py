"""tidemark: market-signal, return and trade analytics as Spark DataFrame jobs."""
