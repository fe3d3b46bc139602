"""All queries of this package; importing a module registers its query."""

from wordloom.llm import bpe, chat, decontam, licenses, linededup, pii, quality, search, secrets, simhash, toxicity, trie, urlfilter  # noqa: F401
from wordloom.llm.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
