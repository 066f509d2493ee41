"""Operators for training-data pipelines: dedup, language, secrets, tokens, mixing, URLs, decontamination."""
