"""Every registered query of the engine itself, and its SQL."""

from __future__ import annotations

from .plans import graphs, history, inventory, more, search, store, upkeep  # noqa: F401
from .plans import deeper, trees  # noqa: F401  (they enter the catalogue)
from .plans.catalogue import ORACLES, QUERIES, Query

FLAGSHIP = "hybrid_search"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
