"""Scoring and refreshing models on streams."""
