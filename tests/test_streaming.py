"""Counts over streams agree with batch counts."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from voxelloom.sources import rasters
from voxelloom.streaming import counts


def test_images_arrive(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    for n in (1, 2):
        (folder / f"m_s00{n}.png").write_bytes(rasters.encode_png(np.eye(4, dtype=np.uint8) * n))
    (folder / "notes.txt").write_text("no image")
    cells = rasters.image_pixels(counts.image_stream(spark, str(folder)), foreground=True)
    sums = cells.groupBy("section_number").agg(F.count("*").alias("n"), F.max("c0").alias("value"))
    query = sums.writeStream.outputMode("complete").format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {tuple(r) for r in spark.table("arrived").collect()} == {(1, 4, 1), (2, 4, 2)}


def test_windows_close(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", 1), ("2024-01-01 00:50:00", 1), ("2024-01-01 01:10:00", 2), ("2024-01-02 00:00:00", 9)]
    points = spark.createDataFrame(rows, "time string, label long").withColumn("time", F.to_timestamp("time"))
    points.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    found = counts.windowed_counts(stream, "time").select(F.col("window.start").cast("string").alias("start"), "label", "pixel_count")
    query = found.writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    closed = {tuple(r) for r in spark.table("windows").collect()}
    assert closed == {("2024-01-01 00:00:00", 1, 2), ("2024-01-01 01:00:00", 2, 1)}
