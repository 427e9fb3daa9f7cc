"""Histogram gradient-boosted trees and training-data operators for Spark."""

__version__ = "0.1.0"
