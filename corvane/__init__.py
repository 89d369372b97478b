"""corvane: hybrid retrieval over text corpora, written as Spark plans."""
