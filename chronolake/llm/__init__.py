"""Training-data operators: search, quality, mixing, language, toxicity, joins, secrets, leaks, scoring, extraction."""
