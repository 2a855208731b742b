"""All registered queries."""

from martlet.plans import (  # noqa: F401 - importing registers the queries
    aggregate,
    calendars,
    facts,
    forecasts,
    monitoring,
    recommend,
    relational,
    semantic,
    texts,
)
from martlet.plans.registry import QUERIES

__all__ = ["QUERIES"]
