"""Training-data operators: formatting, scanning, scoring, deduplication, packing.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
