"""All queries and their SQL."""

from . import casebook, history, lookups, market, news, reports, topics  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
