"""All queries of this package."""

from tidemark.llm import exact, lines, merkle, mixing, negatives, packing, passages, personal, secrets, simhash, spotsigs, tokencount, toxicity  # noqa: F401
from tidemark.llm.registry import ORACLES, QUERIES  # noqa: F401
