"""Training-data operators: near-duplicates, tokenizing, quality, private data, packing, licences.

Nothing outside this subpackage imports it.
"""
