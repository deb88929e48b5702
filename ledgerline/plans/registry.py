"""The registered queries over the driver tables and their DuckDB counterparts."""

from ledgerline.plans.oracle import ORACLE
from ledgerline.plans.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
