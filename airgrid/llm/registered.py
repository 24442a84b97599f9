"""Importing this module fills the catalog of training-data queries."""

from airgrid.llm import (bpe, chat, hard_negatives, near_dedup, prefix_trie, quality_model, quality_rules, sanitisation,  # noqa: F401
                         sharding, substring_dedup, suffix_dedup, tiling, token_output)
