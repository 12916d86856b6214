"""Registered queries. Importing a plan module fills the registry."""

from backuplake.plans.registry import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    from backuplake.plans import content, joined, models, ordered_work, relational, streams  # noqa: F401

    return QUERIES, ORACLES
