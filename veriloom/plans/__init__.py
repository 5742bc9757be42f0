"""All registered queries."""

from . import source_queries  # isort: skip
from . import profile_queries
from . import clean_queries
from . import text_queries
from . import retrieval_queries
from . import relational_queries
from . import evaluation_queries
from . import model_queries
from .registry import ORACLES, QUERIES

__all__ = [
    "ORACLES", "QUERIES", "clean_queries", "evaluation_queries", "model_queries", "profile_queries", "relational_queries",
    "retrieval_queries", "source_queries", "text_queries",
]
