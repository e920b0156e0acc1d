from .catalog import queries, oracle_sql

__all__ = ["queries", "oracle_sql"]
