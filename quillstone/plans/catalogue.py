"""All registered queries over the standard tables, with their SQL."""

from quillstone.plans import analysis, further, memory, ranked, relational, stored, textual  # noqa: F401
from quillstone.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
