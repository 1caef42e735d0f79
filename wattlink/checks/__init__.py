"""Registered queries over the given tables, each with the SQL it is checked against."""

from __future__ import annotations


def registered() -> dict:
    """name -> (callable(spark, sf_dir), SQL or None)"""
    from wattlink.checks import addresses, association, geocoding, registry, streams, tables

    out = {}
    for module in (association, addresses, registry, geocoding, tables, streams):
        out.update(module.QUERIES)
    return out
