"""All queries of this subpackage, and their SQL where it can express them."""

from motifstream.llm import contamination, licenses, neardup, packing, quality, sharding, suffixes, toxicity, urls, warc

QUERIES, SQL = {}, {}
for _module in (quality, sharding, toxicity, neardup, contamination, licenses, packing, warc, urls, suffixes):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
