"""Training-data operators: deduplication, decontamination, quality, tokens, chat and shards.

Nothing else in the package imports this subpackage.
"""
