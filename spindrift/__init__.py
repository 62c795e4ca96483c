"""Document retrieval analytics as Spark DataFrame plans."""
