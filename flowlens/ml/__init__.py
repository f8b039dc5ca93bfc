"""Models on feature tables: Spark ML where it has the model, Spark jobs of our own elsewhere."""
