"""Training-data operators: search, scoring, filtering, formatting and packing.

Nothing else in the library imports this subpackage.
"""
