"""Run settings and the tables that pipelines hand on."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from .storage import located


@dataclass
class Atlas:
    """voxels: x, y, z, label and maybe hemi. labels: idx, name, r, g, b."""

    voxels: DataFrame
    labels: DataFrame
    shape: tuple[int, int, int]
    voxel_size_um: float | None = None

    @property
    def has_hemi(self) -> bool:
        return "hemi" in self.voxels.columns


@dataclass
class Extraction:
    """points: one row per point; objects alike, or None; areas and intensities
    per section and region, or None; files with their number of points."""

    points: DataFrame
    objects: DataFrame | None
    areas: DataFrame | None
    intensities: DataFrame | None
    files: DataFrame | None
    orientation: str
    shape: tuple[int, int, int]
    with_hemi: bool
    with_damage: bool = True


@dataclass
class Settings:
    alignment_json: str
    segmentation_folder: str | None = None
    image_folder: str | None = None
    coordinate_file: str | None = None
    colour: object = None
    intensity_channel: str | None = None
    atlas_name: str | None = None
    atlas_path: str | None = None
    label_path: str | None = None
    hemi_path: str | None = None
    custom_region_path: str | None = None
    voxel_size_um: float | None = None
    min_intensity: float | None = None
    max_intensity: float | None = None
    segmentation_format: str = "binary"

    @classmethod
    def from_dict(cls, found: dict) -> Settings:
        if "alignment_json" not in found:
            raise KeyError("settings need alignment_json")
        made = cls(**{f.name: found[f.name] for f in fields(cls) if found.get(f.name) is not None})
        if not (made.atlas_path and made.label_path):
            made.atlas_path = made.label_path = made.hemi_path = None
        return made

    @classmethod
    def from_file(cls, path: str) -> Settings:
        system, place = located(path)
        with system.open_input_stream(place) as file:
            return cls.from_dict(json.loads(file.read()))

    def normalised(self) -> Settings:
        """An atlas's name tells its voxel size."""
        if self.atlas_name:
            self.voxel_size_um = None
        return self

    def check(self) -> None:
        if sum(map(bool, (self.segmentation_folder, self.image_folder, self.coordinate_file))) > 1:
            raise ValueError("give one of segmentation_folder, image_folder and coordinate_file")
        if self.segmentation_folder and (self.min_intensity is not None or self.max_intensity is not None):
            raise ValueError("intensity bounds go with image_folder only")
        if self.image_folder and self.colour is not None:
            raise ValueError("images have no segmentation colour")
        if self.atlas_name and (self.atlas_path or self.label_path):
            raise ValueError("give an atlas's name or its files, not both")
        if not self.atlas_name and not (self.atlas_path and self.label_path):
            raise ValueError("give an atlas's name, or its atlas_path and label_path")
