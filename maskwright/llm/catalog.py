"""Every query of this package, in one place."""

from maskwright.llm import decontaminate, jaccard, lines, mixing, neighbours, passages, quality, resample, sharding, simhash, toxicity, urls, whitening  # noqa: F401
from maskwright.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
