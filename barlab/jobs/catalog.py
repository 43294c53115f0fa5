"""All queries of the study and the streams, and their SQL."""

from __future__ import annotations

from barlab.jobs import registry, scale, stores, streams, study

__all__ = ["ORACLES", "QUERIES", "scale", "stores", "streams", "study"]

#: Every module of queries adds its own to the registry's tables when it is imported.
QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
