"""Registered queries: derived tables, one query per operator, and its SQL oracle."""

from registry import (catalog_checks, change_checks, confidence_checks, filter_checks,  # noqa: F401
                      pairing_checks, pixel_checks, rerank_checks, source_checks, stream_checks,
                      text_checks, vector_checks)
from registry.base import ORACLES, QUERIES  # noqa: F401
