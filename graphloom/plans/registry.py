"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from graphloom.sources.derived import GRAPH_SQL, StoredGraph

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
_GRAPHS: dict[tuple[str, str], StoredGraph] = {}


def loaded(spark, sf_dir: str) -> StoredGraph:
    """The graph of these tables, loaded once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _GRAPHS:
        _GRAPHS[key] = StoredGraph(spark, sf_dir)
    return _GRAPHS[key]


def query(name: str, sql: str | None = None):
    """Register ``f(graph)`` as a query; ``sql`` may use the tables of GRAPH_SQL.

    ``sql`` is a SELECT, or further common table expressions and a SELECT after ``;;``.
    """

    def register(f):
        QUERIES[name] = lambda spark, sf_dir: f(loaded(spark, sf_dir))
        if sql is not None:
            more, _, select = sql.rpartition(";;")
            SQL[name] = f"WITH RECURSIVE {GRAPH_SQL}{',' + more if more else ''}\n{select}"
        return f

    return register


def also(name: str, known: str) -> None:
    """Register a second name of a query."""
    QUERIES[name] = QUERIES[known]
    if known in SQL:
        SQL[name] = SQL[known]
