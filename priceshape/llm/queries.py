"""All queries of this subpackage."""

from priceshape.llm import (  # noqa: F401
    chat, language, mixing, multi_index, negatives, quality, repair, secrets, sharding, simhash, topk, tree_bpe, varbyte,
)
from priceshape.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
