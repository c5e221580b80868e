"""All registered queries of this package and their SQL."""

from gridlens.llm.queries import QUERIES
from gridlens.llm.sql import ORACLES

__all__ = ["ORACLES", "QUERIES"]
