"""Every operator as a named query over the sample tables."""

from newstide.catalog.registry import QUERIES, SQL


def _load() -> None:
    from newstide.catalog import (  # noqa: F401
        io_queries,
        join_queries,
        model_queries,
        series_queries,
        text_queries,
    )


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    return dict(SQL)
