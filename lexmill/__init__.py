"""lexmill: document retrieval, memory and training-data operators as Spark plans."""
