"""DuckDB statements the Spark queries are checked against."""

from goldrec.oracle import golden, ingest, match, ops  # noqa: F401
from goldrec.oracle.common import SQL

# Other ways to the same rows.
SQL["golden_upsert_stored"] = SQL["golden_upsert"]
SQL["search_by_name_indexed"] = SQL["search_by_name"]

__all__ = ["SQL"]
