"""Training-data operators: language, duplicates, quality, packing, personal data, fingerprints, tokens.

Nothing outside this subpackage imports it.
"""
