"""Queries over the driver's tables. Importing the package registers all of them."""

from . import agreements, cases, followups, pipelines, records, reviews, search, temporal, trees  # noqa: F401
from .registry import QUERIES, SQL, table  # noqa: F401
