"""Operators for preparing large text corpora: near duplicates, tokenizers, search, filters, packing.

Nothing outside this subpackage imports it. ``llm.catalog`` lists its queries and their SQL.
"""
