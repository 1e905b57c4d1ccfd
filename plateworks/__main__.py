"""Command line: `spark-submit` or `python -m plateworks`.

    python -m plateworks split IMAGES OUTPUT [--recursive] [--mode auto|upper|lower] [--crops]
    python -m plateworks folder FOLDER OUTPUT [--recursive]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plateworks.operators import panels
from plateworks.sources import files, sinks


def split(spark: SparkSession, images: str, output: str, recursive: bool = False, mode: str = "auto", with_crops: bool = False) -> None:
    """Splits the images of a folder: panels and records as Parquet, a layout for each image as JSON, and crops and previews if asked."""
    rows = files.images(spark, images, recursive).where("height > 0 AND channels = 3")
    rows = rows.select(F.xxhash64("path").alias("key"), "path", "height", "width", "data")
    panels.split_images(rows, mode=mode).write.mode("overwrite").parquet(f"{output}/panels")
    found = spark.read.parquet(f"{output}/panels")
    names = rows.select("key", F.element_at(F.split("path", "/"), -1).alias("name"))
    panels.split_record(found).join(names, "key").write.mode("overwrite").parquet(f"{output}/records")
    layout = found.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("letter", "x0", "y0", "x1", "y1", "confidence"))).alias("panels")).join(names, "key")
    sinks.write_files(sinks.json_files(layout.select("name", "panels"), F.concat("name", F.lit("/layout.json"))), output)
    if with_crops:
        boxes = found.select("key", F.col("letter").alias("label"), "x0", "y0", "x1", "y1")
        cut = sinks.crops(rows, boxes).join(names, "key")
        sinks.write_files(cut.select(F.concat_ws("/", "name", F.concat("label", F.lit(".png"))).alias("name"), F.col("png").alias("data")), output)
        shown = sinks.previews(rows, boxes).join(names, "key")
        sinks.write_files(shown.select(F.concat("name", F.lit("/preview.png")).alias("name"), F.col("png").alias("data")), output)


def folder(spark: SparkSession, root: str, output: str, recursive: bool = False) -> None:
    """Lists the PDF files of a folder as the items of a batch."""
    files.pdf_folder(spark, root, recursive).write.mode("overwrite").parquet(f"{output}/items")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="plateworks")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("split", "folder"):
        p = commands.add_parser(name)
        p.add_argument("source")
        p.add_argument("output")
        p.add_argument("--recursive", action="store_true")
        if name == "split":
            p.add_argument("--mode", choices=("auto", "upper", "lower"), default="auto")
            p.add_argument("--crops", action="store_true")
    a = parser.parse_args(argv)
    spark = SparkSession.builder.appName("plateworks").getOrCreate()
    if a.command == "split":
        split(spark, a.source, a.output, a.recursive, a.mode, a.crops)
    else:
        folder(spark, a.source, a.output, a.recursive)


if __name__ == "__main__":
    main()
