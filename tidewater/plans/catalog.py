"""All queries of the core; importing the modules registers them."""

from __future__ import annotations

from tidewater.plans import contracts, documents, files, golden, registry, results, speech, streams, training  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
