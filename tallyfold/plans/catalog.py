"""All registered queries."""

from . import account_queries, award_queries, branch_queries, service_queries, stream_queries, table_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
