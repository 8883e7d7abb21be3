"""Training-data operators: deduplication, filtering, mixing and token output.

Nothing outside this subpackage imports it.
"""
