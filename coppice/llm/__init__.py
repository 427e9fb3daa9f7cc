"""Training-data operators: search, selection, filtering, mixing, tokenizing
and near-duplicate detection over tables of documents and vectors.

Nothing else in the library imports this subpackage.
"""
