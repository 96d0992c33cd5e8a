"""Training-data operators: de-duplication, extraction, filtering, packing and privacy.

Nothing outside this subpackage imports it.
"""
