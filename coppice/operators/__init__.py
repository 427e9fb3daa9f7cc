"""Relational operators of training and inference."""
