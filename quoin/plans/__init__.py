"""All queries over the editorial data model."""

from quoin.plans import analytics, batching, corrections, items, lifecycle, mining, tables  # noqa: F401
from quoin.plans.registry import QUERIES, SQL
from quoin.streaming import machines, states

for streams in (states, machines):
    QUERIES.update(streams.QUERIES)
    SQL.update(streams.SQL)
