"""The queries of this library's own operators and their SQL."""

from driftlake.plans import batches, streams

QUERIES: dict = {**streams.QUERIES, **batches.QUERIES}
ORACLE_SQL: dict[str, str] = {**streams.ORACLE_SQL, **batches.ORACLE_SQL}
