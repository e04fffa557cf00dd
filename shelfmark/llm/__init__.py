"""Operators for text corpora: scans, near duplicates, language, tokens.

Nothing outside this package imports it. Each module holds one operator with
its own interface; ``queries`` derives the registered results from them.
"""
