"""Named queries over the given tables, with the SQL that each must equal."""

from tributary.plans import clean, evaluate, files, graph, stream

_PARTS = (clean, graph, evaluate, files, stream)
QUERIES: dict = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
