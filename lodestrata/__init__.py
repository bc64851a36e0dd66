"""lodestrata: retrieval, graph and analytics operators expressed as Spark plans."""
