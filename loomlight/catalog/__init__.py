"""Queries over the given tables, one or more per operator, with their checks.

``QUERIES`` holds every entry by name. An entry builds a DataFrame from
(spark, folder of tables) and, where SQL can say the same over the whole
tables, carries that SQL.
"""

from loomlight.catalog import (  # noqa: F401
    aggregates,
    chunking,
    retrieval,
    scalars,
    sessions,
    sources,
    streams,
)
from loomlight.catalog.registry import QUERIES  # noqa: F401
