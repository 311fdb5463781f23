"""Registered queries by topic, each with the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

TOPICS = (
    "traffic",
    "features",
    "series",
    "admission",
    "models",
    "tables",
    "documents",
    "retrieval",
    "streaming",
    "stores",
)


def _collect(attribute: str) -> dict:
    merged: dict = {}
    for topic in TOPICS:
        entries = getattr(import_module(f"callscope.plans.{topic}"), attribute)
        assert not set(entries) & set(merged), f"duplicate query names in {topic}"
        merged.update(entries)
    return merged


def queries() -> dict:
    return _collect("QUERIES")


def oracles() -> dict:
    return _collect("ORACLES")
