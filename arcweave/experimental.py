"""Operators whose interface may change."""

from arcweave.operators.components import wcc, wcc_count

__all__ = ["wcc", "wcc_count"]
