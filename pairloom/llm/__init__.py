"""Operators for training data of language models; nothing outside imports this."""
