"""Training-data operators: text dedup, filtering, mixing and token output, as Spark jobs."""
