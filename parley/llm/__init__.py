"""Training-data operators: token counts, packing, dedup, extraction, filtering.

Nothing outside this subpackage imports it.
"""
