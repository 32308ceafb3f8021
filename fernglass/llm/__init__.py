"""Operators on texts and vectors for training data; nothing outside this folder imports it."""
