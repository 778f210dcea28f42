"""Registered queries and their SQL."""

from . import bodies, indexes, lists, mail, talks, texts  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
