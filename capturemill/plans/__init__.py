"""All registered queries; importing the query modules fills the catalog."""

from capturemill.plans import (  # noqa: F401
    image_queries, log_queries, mesh_queries, pair_queries, point_queries, source_queries,
    stream_queries,
)
from capturemill.plans.catalog import CATALOG

__all__ = ["CATALOG"]
