"""Training-data operators: quality, packing, search, deduplication, tokenizing, personal data, chat.

Nothing else in the library imports this subpackage.
"""
