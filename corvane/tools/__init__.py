"""Entry points: building a corpus with judgements, and evaluating retrieval on it."""
