"""The op queries of this subpackage and the SQL that checks them."""

from . import chat, decontaminate, jaccard, lines, neighbours, quality, repair, resample, sentencepiece_scan, simhash, token_counts, token_files, urls

QUERIES: dict = {}
SQL: dict = {}
for _module in (chat, decontaminate, jaccard, lines, neighbours, quality, repair, resample, sentencepiece_scan, simhash, token_counts, token_files, urls):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
