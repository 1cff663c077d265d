"""Queries by topic; importing this package registers them all."""

from . import admission, combined, detection, detectors, files, lifecycle, lookups, operations, paired, recursions, regimes, streaming, subnets, traffic, windows
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "admission", "combined", "detection", "detectors", "files", "lifecycle", "lookups", "operations", "paired", "recursions", "regimes", "streaming", "subnets", "traffic", "windows"]
