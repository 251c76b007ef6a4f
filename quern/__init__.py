"""quern: analytics and dataset-curation operators as pure functions on Spark DataFrames."""

from quern.session import get_session, table

__all__ = ["get_session", "table"]
