"""Column builders: text, vectors, ranking metrics."""
