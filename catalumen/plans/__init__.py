"""Named queries; importing this package fills the registry."""

from catalumen.plans import artefacts, catalogue, linear, listings, multiview, reliability, sources, streams, texts  # noqa: F401
from catalumen.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
