"""Composite plans and the query registry."""
from docfields.plans.registry import ORACLES, QUERIES, register  # noqa: F401


def load_all():
    """Import every query module so the registry is filled."""
    from docfields.plans import (  # noqa: F401
        q_edits, q_fields, q_lifecycle, q_locate, q_report, q_retrieve, q_stream, q_text)

    return QUERIES, ORACLES
