"""Spatial quantification of serial sections on Spark."""

from __future__ import annotations

import importlib

__all__ = [
    "AtlasData",
    "ExtractionResult",
    "PointSetResult",
    "RegistrationData",
    "image_to_coords",
    "interpolate_volume",
    "load_custom_atlas",
    "quantify_coords",
    "read_alignment",
    "resolve_atlas",
    "save_analysis",
    "save_volume_niftis",
    "seg_to_coords",
    "xy_to_coords",
]


def __getattr__(name: str) -> object:
    """Public names load the library when they are first asked for."""
    if name in __all__:
        return getattr(importlib.import_module("voxelloom.api"), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
