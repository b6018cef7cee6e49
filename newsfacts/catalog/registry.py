"""Imports every section so that its queries are registered."""

from newsfacts.catalog import extraction, facts, flows, mining, places, repairs, texts  # noqa: F401
from newsfacts.catalog.base import ORACLE, QUERIES  # noqa: F401
