"""Operators for preparing training corpora; nothing else in the library imports this package.

``QUERIES`` and ``ORACLES`` are filled by the modules named in ``queries``.
"""

from .queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
