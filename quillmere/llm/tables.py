"""Intermediate tables of the training-data operators."""

from __future__ import annotations

from quillmere.functions.tables import drop_staged, shared_folder, staged

__all__ = ["drop_staged", "shared_folder", "staged"]
