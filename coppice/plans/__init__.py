"""Training plans made of the operators."""
