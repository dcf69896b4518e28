"""Sources: generators, frame tables and views on the given tables."""
