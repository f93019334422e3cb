"""Operators for training data of language models, with their queries.

Nothing else in the library imports this subpackage.
"""

from millrace.llm import (  # noqa: F401
    curriculum,
    itq,
    language_id,
    merkle,
    multi_index,
    order_minhash,
    prefix_bpe,
    prefix_trie,
    rendezvous,
    repair,
    spot_sigs,
    toxicity,
    warc,
)
from millrace.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
