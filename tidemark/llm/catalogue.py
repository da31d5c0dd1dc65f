"""All registered queries of this package."""

from tidemark.llm import conversations, decontamination, jaccard, lines, merkle, mixing, packing, rules, secrets, suffixes, toxicity, urls, vectors  # noqa: F401
from tidemark.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
