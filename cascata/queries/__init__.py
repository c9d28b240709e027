"""Driver-facing queries of the engine."""

from __future__ import annotations

from cascata.queries import evaluation, graphs, hawkes, ingest, learning, propagation, rules, streams, topology, windows
from cascata.queries.registry import ORACLES, QUERIES


def flagship(spark, sf_dir):
    """Alarms to parents to cascades to one diagnostic row per cascade."""
    return QUERIES["group_diagnostics"](spark, sf_dir)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)


_ = (evaluation, graphs, hawkes, ingest, learning, propagation, rules, streams, topology, windows)
