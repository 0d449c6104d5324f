"""Training-data operators: chat formatting, tokenizing, packing, classifiers, near-duplicates, search, extraction.

Nothing outside this subpackage imports it. ``queries`` holds the registered queries and their SQL.
"""
