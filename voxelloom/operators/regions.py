"""Tables per atlas region: counts, areas, intensities, fractions, rollups.

Tables of regions have a row per label and are small beside points and pixels;
everything large is aggregated once, with map-side partial sums, before it
meets them. Join strategies are left to the optimizer, which knows the sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import mean_or_zero, ratio

LABELS = ("idx", "name", "r", "g", "b")
SIDES = ((1, "left_hemi_"), (2, "right_hemi_"))
STATES = ((True, "undamaged_"), (False, "damaged_"))

#: (numerator, denominator, result), in output order.
AREA_FRACTIONS = tuple(
    (f"{p}pixel_count{'s' if 'damaged' in p else ''}", f"{p}region_area", f"{p}area_fraction")
    for p in ("", "left_hemi_", "right_hemi_", "undamaged_", "left_hemi_undamaged_", "right_hemi_undamaged_")
)
MEANS = tuple((f"{p}sum_intensity", f"{p}pixel_count", f"{p}mean_intensity") for p in ("", "left_hemi_", "right_hemi_"))


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


def count_columns(with_hemi: bool, with_damage: bool) -> list[tuple[str, list[Column], str]]:
    """(name, predicates, entity) of every count."""
    sides = [(None, ""), *(SIDES if with_hemi else ())]
    states = [(None, ""), *(STATES if with_damage else ())]
    found = []
    for entity in ("pixel_count", "object_count"):
        for side, p in sides:
            for state, q in states:
                tests = [F.col("hemi") == side] if side is not None else []
                tests += [F.col("undamaged") == state] if state is not None else []
                found.append((p + q + entity + ("s" if q and entity == "pixel_count" else ""), tests, entity))
    return found


def count_by_label(points: DataFrame, objects: DataFrame | None, with_hemi: bool = True, with_damage: bool = True) -> DataFrame:
    """One row per non-negative label of points or objects, with all counts from
    a single aggregation. Totals hold points of no hemisphere; a null
    `undamaged` counts as undamaged."""

    def rows(df: DataFrame, entity: str) -> DataFrame:
        hemi = F.col("hemi") if with_hemi else F.lit(None).cast("int")
        state = F.coalesce("undamaged", F.lit(True)) if with_damage else F.lit(True)
        return df.select(F.col("label").cast("long").alias("idx"), hemi.alias("hemi"), state.alias("undamaged"), F.lit(entity).alias("entity"))

    every = rows(points, "pixel_count")
    if objects is not None:
        every = every.unionByName(rows(objects, "object_count"))
    counts = [
        F.count_if(_all([F.col("entity") == entity, *tests])).alias(name)
        for name, tests, entity in count_columns(with_hemi, with_damage)
    ]
    return every.filter("idx >= 0").groupBy("idx").agg(*counts)


def filtered_lengths(points: DataFrame, sections: DataFrame) -> DataFrame:
    """n, the undamaged points of each section; 0 for sections without any. A null
    `undamaged` counts as undamaged."""
    n = F.count_if(F.coalesce("undamaged", F.lit(True))).alias("n")
    found = points.groupBy("section_number").agg(n)
    return sections.select("section_number").distinct().join(found, "section_number", "left").fillna(0, ["n"])


def region_counts(
    points: DataFrame, objects: DataFrame | None, labels: DataFrame, with_hemi: bool = True, with_damage: bool = True
) -> DataFrame:
    """Counts of the labels that occur, with name and colour. Label 0 becomes
    `out_of_atlas` where labels lack it; other unknown labels are left out."""
    counts = count_by_label(points, objects, with_hemi, with_damage)
    named = labels.select(*LABELS).join(counts, "idx")
    zero = counts.filter("idx = 0").join(labels.filter("idx = 0").select("idx"), "idx", "left_anti")
    extra = {"name": F.lit("out_of_atlas"), **{c: F.lit(0) for c in "rgb"}}
    return named.unionByName(zero.select("idx", *(v.cast(labels.schema[c].dataType).alias(c) for c, v in extra.items()), *counts.columns[1:]))


def region_areas(pixels: DataFrame, with_hemi: bool = True, with_damage: bool = True, polarity: str = "reference") -> DataFrame:
    """Areas per (section_number, label) of atlas rasters. `scale` turns a pixel
    into area; `undamaged` is the damage mask's value. With polarity
    `reference`, mask value 0 is named undamaged; `corrected` names it damaged."""
    named = {"undamaged_": polarity != "reference", "damaged_": polarity == "reference"}
    area = F.coalesce("scale", F.lit(1.0)).cast("double")
    leaves = {}
    for side, p in SIDES if with_hemi else ((None, ""),):
        for q in named if with_damage else ("",):
            tests = [F.col("hemi") == side] if side is not None else []
            tests += [F.coalesce("undamaged", F.lit(True)) == named[q]] if q else []
            leaves[p + q + "region_area"] = F.sum(F.when(_all(tests), area).otherwise(0.0) if tests else area)
    found = pixels.groupBy("section_number", F.col("label").cast("long").alias("idx")).agg(*[v.alias(k) for k, v in leaves.items()])
    if with_hemi and with_damage:
        for q in named:
            found = found.withColumn(f"{q}region_area", F.col(f"left_hemi_{q}region_area") + F.col(f"right_hemi_{q}region_area"))
        for _, p in SIDES:
            found = found.withColumn(f"{p}region_area", F.col(f"{p}undamaged_region_area") + F.col(f"{p}damaged_region_area"))
    if with_damage:
        return found.withColumn("region_area", F.col("undamaged_region_area") + F.col("damaged_region_area"))
    if with_hemi:
        return found.withColumn("region_area", F.col("left_hemi_region_area") + F.col("right_hemi_region_area"))
    return found


def combine_areas(*sections: DataFrame) -> DataFrame:
    """Areas of a series: sums per label, a missing column counting as 0."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), sections)
    columns = [c for c in every.columns if c.endswith("region_area")]
    return every.groupBy("idx").agg(*[F.sum(F.coalesce(c, F.lit(0.0))).alias(c) for c in columns])


def with_area_fractions(df: DataFrame) -> DataFrame:
    for n, d, name in AREA_FRACTIONS:
        if n in df.columns and d in df.columns:
            df = df.withColumn(name, ratio(F.col(n), F.col(d)))
    return df


def with_mean_intensities(df: DataFrame) -> DataFrame:
    for n, d, name in MEANS:
        if n in df.columns and d in df.columns:
            df = df.withColumn(name, mean_or_zero(F.col(n), F.col(d)))
    return df


def region_table(counts: DataFrame, labels: DataFrame, areas: DataFrame | None = None) -> DataFrame:
    """All regions of the label table with areas, counts and fractions, missing
    ones 0, then regions that only counts have. `label_ordinal` carries the
    label table's order."""
    order = labels if "label_ordinal" in labels.columns else labels.withColumn("label_ordinal", F.col("idx"))
    numbers = sorted(c for c in counts.columns if c not in LABELS)
    area_columns = sorted(c for c in areas.columns if c not in ("idx", "section_number")) if areas is not None else []
    base = order.join(areas.select("idx", *area_columns), "idx", "left") if areas is not None else order
    base = base.join(counts.select("idx", *numbers), "idx", "left")
    extra = counts.join(labels.select("idx"), "idx", "left_anti")
    zeros = {c: F.lit(None).cast("long" if c == "label_ordinal" else "double") for c in base.columns if c not in extra.columns}
    extra = extra.select("*", *(v.alias(c) for c, v in zeros.items()))
    every = base.unionByName(extra.select(base.columns))
    every = every.fillna(0, subset=[*area_columns, *numbers])
    return with_area_fractions(every)


def region_intensities(pixels: DataFrame, with_hemi: bool = True) -> DataFrame:
    """Sums and counts of intensity per (section_number, label). Pixels set to 0
    by bounds still count; damaged pixels belong to region 0 with value 0, and
    to no hemisphere."""
    state = F.coalesce("undamaged", F.lit(True))
    rows = pixels.select(
        "section_number",
        F.when(state, F.col("label")).otherwise(F.lit(0)).cast("long").alias("idx"),
        F.when(state, F.col("value").cast("double")).otherwise(F.lit(0.0)).alias("value"),
        (F.when(state, F.col("hemi")) if with_hemi else F.lit(None).cast("int")).alias("hemi"),
    )
    sums = [F.sum("value").alias("sum_intensity"), F.count("*").alias("pixel_count")]
    for side, p in SIDES if with_hemi else ():
        sums.append(F.sum(F.when(F.col("hemi") == side, F.col("value")).otherwise(0.0)).alias(f"{p}sum_intensity"))
        sums.append(F.count_if(F.col("hemi") == side).alias(f"{p}pixel_count"))
    return rows.groupBy("section_number", "idx").agg(*sums)


def combine_intensities(intensities: DataFrame) -> DataFrame:
    keys = {"section_number", "idx", *LABELS}
    return intensities.groupBy("idx").agg(*[F.sum(c).alias(c) for c in intensities.columns if c not in keys and not c.endswith(("mean_intensity", "area_fraction"))])


def quantify_intensity(series: DataFrame, labels: DataFrame) -> DataFrame:
    """All regions of the label table with mean intensities, missing ones 0;
    labels that the table lacks are left out."""
    numbers = [c for c in series.columns if c != "idx"]
    return with_mean_intensities(labels.join(series, "idx", "left").fillna(0, subset=numbers))


def check_crosswalk(crosswalk: DataFrame) -> None:
    """Raises if a region belongs to two custom regions."""
    twice = crosswalk.groupBy("subregion_id").agg(F.count_distinct("custom_id").alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"regions in more than one custom region: {[r[0] for r in twice]}")


def map_to_custom(rows: DataFrame, crosswalk: DataFrame, label: str = "label") -> DataFrame:
    """Adds custom_id, 0 for labels of no custom region."""
    keys = crosswalk.select(F.col("subregion_id").alias(label), "custom_id").dropDuplicates([label])
    return rows.join(keys, label, "left").withColumn("custom_id", F.coalesce("custom_id", F.lit(0)))


def roll_up(table: DataFrame, crosswalk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums per custom region with its ratios made anew, and the table with each
    region's custom_region_name (empty where it has none)."""
    names = crosswalk.select(F.col("subregion_id").alias("idx"), "custom_name", *[F.col(c).alias(f"_{c}") for c in "rgb" if c in crosswalk.columns])
    known = table.join(names.dropDuplicates(["idx"]), "idx", "left")
    annotated = known.withColumn("custom_region_name", F.coalesce("custom_name", F.lit(""))).drop("custom_name", "_r", "_g", "_b")
    derived = {x[2] for x in (*AREA_FRACTIONS, *MEANS)}
    numeric = [f.name for f in table.schema if f.dataType.typeName() in ("long", "integer", "double", "float", "short") and f.name not in {*LABELS, "label_ordinal", *derived}]
    colours = [F.first(f"_{c}").alias(c) for c in "rgb" if f"_{c}" in known.columns]
    grouped = known.filter("custom_name is not null").groupBy(F.col("custom_name").alias("name")).agg(*[F.sum(c).alias(c) for c in numeric], *colours)
    return with_mean_intensities(with_area_fractions(grouped)), annotated
