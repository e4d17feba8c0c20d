"""Operators for preparing large text, page and vector collections for training."""
