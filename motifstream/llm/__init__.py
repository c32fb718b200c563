"""Training-data operators: quality, sharding, toxicity, dedup, licences, packing, archives, URL filters.

Nothing outside this subpackage imports it.
"""
