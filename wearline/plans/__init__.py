"""Registered queries.  Importing this package fills ``REGISTRY``."""

from . import anomaly, anomaly_eval, features, ingest, metrics, models, splits, stats, streams, validation  # noqa: F401
from .registry import REGISTRY, Query, finish, register  # noqa: F401
