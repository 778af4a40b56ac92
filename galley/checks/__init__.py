"""Queries over the test tables, each with the SQL that must give the same rows."""

from galley.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "load_all"]


def load_all() -> None:
    from galley.checks import documents, jobs, links, markup, scalars, texts  # noqa: F401
