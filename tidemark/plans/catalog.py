"""All registered queries: importing the plan modules fills the registry."""

from tidemark.plans import streams  # noqa: F401, I001  (first: the stream queries take longest to start)
from tidemark.plans import detect, encode, evaluate, grid, language, prepare  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
