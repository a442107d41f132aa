"""Registered queries: one per operator, with the SQL that checks it."""

from . import (  # noqa: F401
    q_aggregate, q_features, q_flows, q_iterative, q_join, q_pixel, q_source, q_tiles,
)
from .registry import ORACLES, QUERIES  # noqa: F401
