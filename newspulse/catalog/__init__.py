"""Registered queries over the test tables, each with the SQL it is checked against."""

from newspulse.catalog.base import ORACLES, QUERIES
from newspulse.catalog import cleaning, entities, flows, html, relational, sentiment, topics  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
