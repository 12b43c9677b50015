"""DuckDB oracle: one SQL string per registered job (see ``ORACLE``)."""

from oracle.queries import ORACLE  # noqa: F401
