"""Projections of the benchmark tables onto the operators' inputs, as SQL that
Spark and DuckDB both read; rasters and volumes have a text for each."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHAPE = (110, 75, 64)

VIEWS = {
    "fx_labels": """select cast(p_partkey as bigint) as idx, p_name as name, cast(p_size * 5 % 256 as int) as r,
        cast(p_size * 3 % 256 as int) as g, cast(p_size as int) as b from {part} where p_partkey between 1 and 150""",
    "fx_points": """select cast(l_suppkey % 10 as int) as section_number, cast(l_partkey % 160 as bigint) as label,
        cast(case l_returnflag when 'A' then 1 when 'R' then 2 else 0 end as int) as hemi, l_linestatus = 'O' as undamaged,
        cast(l_quantity as bigint) as intensity, l_orderkey, l_linenumber from {lineitem}""",
    "fx_objects": """select cast(o_orderkey % 10 as int) as section_number, cast(o_custkey % 160 as bigint) as label,
        cast(o_orderkey % 3 as int) as hemi, o_orderkey % 4 <> 0 as undamaged, o_orderkey from {orders}""",
    "fx_sections": """select cast(n_nationkey as int) as section_number, 250 as width, 75 as height,
        cast(2 as double) as ox, cast(n_nationkey * 4 - 5 as double) as oy, cast(60 as double) as oz,
        cast(100 as double) as ux, cast(4 as double) as uy, cast(-2 as double) as uz,
        cast(-3 as double) as vx, cast(1 as double) as vy, cast(-58 as double) as vz from {nation}""",
    "fx_xy": """select event_id, cast(event_id % 27 as int) as section_number, cast(value as double) as x,
        cast(user_id as double) as y, 500 as image_width, 150 as image_height from {events}""",
    "fx_custom": """select cast(p_partkey % 5 + 1 as bigint) as custom_id,
        concat('custom_', cast(p_partkey % 5 + 1 as string)) as custom_name,
        cast(p_partkey as bigint) as subregion_id from {part} where p_partkey between 1 and 120""",
    "fx_grid": """select cast(c_custkey % 25 as int) as section_number, cast((c_custkey - c_custkey % 25) / 25 as int) as grid_pos,
        cast(case when c_acctbal < 0 then 4 else 0 end as int) as grid_value from {customer}""",
}

RASTER = {
    "spark": """select cast(vec_id as int) as section_number, cast(p div 8 as int) y, cast(p % 8 as int) x, cast(v as double) v
        from (select vec_id, posexplode(embedding) as (p, v) from {embeddings})""",
    "duckdb": """select cast(vec_id as int) as section_number, cast((i - 1) // 8 as int) y, cast((i - 1) % 8 as int) x,
        cast(embedding[i] as double) v from embeddings, range(1, 65) t(i)""",
}
XYZ = {
    "spark": "select vec_id, cast(embedding[0] as double) x, cast(embedding[1] as double) y, cast(embedding[2] as double) z from {embeddings}",
    "duckdb": "select vec_id, cast(embedding[1] as double) x, cast(embedding[2] as double) y, cast(embedding[3] as double) z from embeddings",
}
VOXELS = """select cast(a.x as int) x, cast(b.y as int) y, cast(c.z as int) z,
    cast((cast(floor(a.x / cast(10 as double)) as bigint) * 7 + cast(floor(b.y / cast(10 as double)) as bigint) * 3
        + cast(floor(c.z / cast(8 as double)) as bigint)) % 160 as bigint) as label, case when a.x < 55 then 1 else 2 end as hemi
    from range(110) a(x), range(75) b(y), range(64) c(z)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = {"fx_raster": RASTER["spark"], "fx_xyz": XYZ["spark"]}.get(name) or VIEWS[name]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", text)})


def voxels(spark: SparkSession) -> DataFrame:
    nx, ny, nz = SHAPE
    at = spark.range(nx * ny * nz)
    found = at.selectExpr(f"cast(id div {ny * nz} as int) x", f"cast(id div {nz} % {ny} as int) y", f"cast(id % {nz} as int) z")
    label = F.expr("(x div 10 * 7 + y div 10 * 3 + z div 8) % 160").cast("long")
    return found.select("x", "y", "z", label.alias("label"), F.when(F.col("x") < 55, 1).otherwise(2).alias("hemi"))


def ctes(*names: str) -> str:
    """A WITH clause for DuckDB that defines the views by name."""
    special = {"fx_raster": RASTER["duckdb"], "fx_xyz": XYZ["duckdb"], "fx_voxels": VOXELS}
    return "with " + ", ".join(f"{n} as ({special.get(n) or re.sub(r'[{}]', '', VIEWS[n])})" for n in names) + " "
