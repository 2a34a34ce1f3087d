"""Column expressions: text keys, similarity, brands, time, dates."""
