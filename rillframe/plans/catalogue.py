"""All core queries by name, and their SQL."""

from __future__ import annotations

from rillframe.plans import clock, events, expressions, joins, motion, problems, records, statistics, streams, views
from rillframe.plans.registry import Query

FLAGSHIP = "split_plan"

REGISTRIES = (clock.query, joins.query, events.query, statistics.query, expressions.query, motion.query, records.query, views.query, streams.query, problems.query)

QUERIES: dict[str, Query] = {name: f for r in REGISTRIES for name, f in r.queries.items()}

ORACLES: dict[str, str] = {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
