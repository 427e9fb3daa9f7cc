"""Scalar functions, losses and metrics as column expressions."""
