"""Operators for preparing training text. Nothing else in the library imports this package.

warc, quality_rules, mixing, toxicity, substring, packing, quality_mil, chat, jaccard and pivots
hold one operator each; words holds the shared vectorised word splitter; queries registers them.
"""
