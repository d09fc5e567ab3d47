"""Operators for preparing training data: text, secrets, mixes, duplicates, language models."""
