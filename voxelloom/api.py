"""The library's public functions, over the session that is active.

Atlases are Atlas objects, or whatever `resolve_atlas` takes; registrations are
DataFrames with one row per section; results are Extractions of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import model
from .operators import volume
from .plans import pipelines
from .sinks import exports
from .sources import atlases, registration, tables

AtlasData = model.Atlas
ExtractionResult = model.Extraction
#: Points, objects and registrations are tables.
PointSetResult = RegistrationData = DataFrame


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def read_alignment(path: str, loader_name: str | None = None, apply_deformation: bool = True, apply_damage: bool = True,
                   deformation_provider: Callable[[DataFrame], DataFrame] | None = None,
                   damage_provider: Callable[[DataFrame], DataFrame] | None = None,
                   atlas_shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Sections of a registration file. Providers take the sections and replace
    their markers, field folders or grids. Files of slice corners need the raw
    atlas's shape."""
    return registration.read_registration(session(), path, loader_name, atlas_shape, apply_deformation, apply_damage, deformation_provider, damage_provider)


def load_custom_atlas(atlas_path: str, hemi_path: str | None, label_path: str, voxel_size_um: float | None = None) -> model.Atlas:
    return atlases.custom_atlas(session(), atlas_path, label_path, hemi_path, voxel_size_um)


def resolve_atlas(atlas: object) -> model.Atlas:
    return atlases.resolve_atlas(session(), atlas)


def seg_to_coords(folder: str, registration: DataFrame, atlas: object, pixel_id: object = (0, 0, 0), object_cutoff: int = 0,
                  segmentation_format: str = "binary", return_orientation: str = "asr") -> model.Extraction:
    colour = pipelines.parse_colour(pixel_id) if segmentation_format == "binary" else pixel_id
    return pipelines.segmentation_to_atlas(session(), folder, registration, resolve_atlas(atlas), colour, object_cutoff, segmentation_format, return_orientation)


def image_to_coords(folder: str, registration: DataFrame, atlas: object, intensity_channel: str = "grayscale", min_intensity: float | None = None,
                    max_intensity: float | None = None, return_orientation: str = "asr") -> model.Extraction:
    return pipelines.image_to_atlas(session(), folder, registration, resolve_atlas(atlas), intensity_channel, min_intensity, max_intensity, return_orientation)


def xy_to_coords(coordinates: DataFrame | str, registration: DataFrame, atlas: object, return_orientation: str = "asr") -> model.Extraction:
    """coordinates: a path, or a table with the columns of a coordinate file."""
    found = tables.read_coordinates(session(), coordinates) if isinstance(coordinates, str) else coordinates
    if "ordinal" not in found.columns:
        found = tables.named_coordinates(tables.check_coordinates(found))
    return pipelines.xy_to_atlas(found, registration, resolve_atlas(atlas), return_orientation)


def quantify_coords(result: model.Extraction, atlas_labels: object) -> DataFrame:
    return pipelines.quantify(result, tables.resolve_labels(session(), atlas_labels))


def save_analysis(output_folder: str, result: model.Extraction, atlas_labels: object, label_df: DataFrame | None = None, colormap: str = "gray",
                  settings_dict: dict | None = None) -> None:
    exports.save_analysis(output_folder, result, tables.resolve_labels(session(), atlas_labels), label_df, colormap, settings_dict)


def interpolate_volume(*, segmentation_folder: str, alignment_json: str, colour: object, atlas: object, scale: float = 1.0,
                       missing_fill: float = float("nan"), do_interpolation: bool = True, k: int = 5, use_atlas_mask: bool = True,
                       value_mode: str = "pixel_count", segmentation_format: str = "binary", segmentation_mode: bool = True,
                       intensity_channel: str = "grayscale", min_intensity: float | None = None, max_intensity: float | None = None,
                       return_orientation: str = "asr") -> DataFrame:
    """Voxels with value, freq and damage."""
    return pipelines.volume_from_images(
        session(), segmentation_folder, read_alignment(alignment_json), resolve_atlas(atlas), colour, scale, value_mode, k, do_interpolation, use_atlas_mask,
        missing_fill, segmentation_format, segmentation_mode, intensity_channel, min_intensity, max_intensity, return_orientation,
    )


def save_volume_niftis(*, output_folder: str, voxels: DataFrame, atlas: model.Atlas, scale: float = 1.0, return_orientation: str = "asr",
                       voxel_size_um: float | None = None, damage: bool = True) -> None:
    """The volumes of interpolate_volume, scaled to bytes, one file each."""
    from .operators.geometry import shape_in

    turn = lambda shape: shape_in(shape, return_orientation)
    size = voxel_size_um if voxel_size_um is not None else atlas.voxel_size_um
    rows = voxels.withColumn("value", F.col("value").cast("double"))
    exports.save_volumes(output_folder, rows, turn(volume.volume_shape(atlas.shape, scale)), 1.0 if size is None else float(size), turn(atlas.shape), damage)
