"""Sinks: JSON lines, label files, images, and versions, written by the tasks and committed by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plateworks.runtime import ship


def write_jsonl(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Rows as JSON lines, sorted over the whole folder (a range shuffle, not one file)."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_files(files: DataFrame, root: str) -> int:
    """Writes one file a row (name, data as binary) under root, through the file system that the URI names; returns their number.

    The task that has the row writes a file of another name first and moves it, so a file is there whole or not at
    all, and writing it again replaces it. Rows with a null name or null data are left out; of one name the greatest data hold.
    """

    def write(batches):
        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        made = set()
        for b in batches:
            for name, data in zip(b["name"], b["data"]):
                target = f"{base}/{name}"
                folder, _, last = target.rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{folder}/.{last}.part") as out:
                    out.write(data)
                system.move(f"{folder}/.{last}.part", target)
            yield pd.DataFrame({"n": [len(b)]})

    rows = files.where("name IS NOT NULL AND data IS NOT NULL").groupBy("name").agg(F.max("data").alias("data"))
    return rows.mapInPandas(write, "n bigint").agg(F.sum("n")).first()[0] or 0


def remove_files(names: DataFrame, root: str) -> int:
    """Removes the named files under root where they are there; returns how many names there were."""

    def remove(batches):
        import pandas as pd
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for name in b["name"]:
                if system.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
                    system.delete_file(f"{base}/{name}")
            yield pd.DataFrame({"n": [len(b)]})

    return names.where("name IS NOT NULL").select("name").distinct().mapInPandas(remove, "n bigint").agg(F.sum("n")).first()[0] or 0


def write_labels(labels: DataFrame, root: str, key: str = "sample_id", text: str = "label_text") -> int:
    """One text file for each key under root; an empty text is an empty file."""
    return write_files(labels.where(F.col(key).isNotNull()).select(F.concat(F.col(key), F.lit(".txt")).alias("name"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data")), root)


def json_files(df: DataFrame, name: Column) -> DataFrame:
    """(name, data): each row as one JSON text for write_files()."""
    return df.select(name.alias("name"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).cast("binary").alias("data"))


def png(image) -> bytes:
    """A picture (height x width x 3, blue, green, red) as PNG."""
    import struct
    import zlib

    import numpy as np

    high, wide = image.shape[:2]
    rows = np.concatenate([np.zeros((high, 1), np.uint8), np.ascontiguousarray(image[:, :, ::-1]).reshape(high, wide * 3)], axis=1)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def crops(images: DataFrame, boxes: DataFrame, margin: int = 0) -> DataFrame:
    """(key, label, width, height, png): the parts of each image that its boxes name; boxes outside the image or empty give no row.

    images: key, height, width, data; boxes: key, label, x0, y0, x1, y1 in pixels. The boxes of an image travel to it, the
    pictures are shuffled once by key and cut where they are.
    """
    spark = images.sparkSession
    ship(spark)
    own = boxes.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("label", *[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]))).alias("boxes"))

    def cut(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                except (ValueError, TypeError):
                    continue
                for q in r.boxes:
                    x0, y0, x1, y1 = max(0, q["x0"] - margin), max(0, q["y0"] - margin), min(r.width, q["x1"] + margin), min(r.height, q["y1"] + margin)
                    if x0 < x1 and y0 < y1:
                        rows.append((r.key, q["label"], x1 - x0, y1 - y0, png(image[y0:y1, x0:x1])))
            yield pd.DataFrame(rows, columns=["key", "label", "width", "height", "png"])

    return images.select("key", "height", "width", "data").join(own, "key").mapInPandas(cut, "key bigint, label string, width int, height int, png binary")


def previews(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """(key, png): each image with the frames of its boxes drawn on it, two pixels wide."""
    spark = images.sparkSession
    ship(spark)
    own = boxes.groupBy("key").agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")])).alias("boxes"))

    def draw(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3).copy()
                except (ValueError, TypeError):
                    continue
                for q in r.boxes if r.boxes is not None else []:
                    x0, y0, x1, y1 = max(0, q["x0"]), max(0, q["y0"]), min(r.width, q["x1"]), min(r.height, q["y1"])
                    for part in (image[y0 : y0 + 2, x0:x1], image[max(y0, y1 - 2) : y1, x0:x1], image[y0:y1, x0 : x0 + 2], image[y0:y1, max(x0, x1 - 2) : x1]):
                        part[:] = (0, 0, 220)
                rows.append((r.key, png(image)))
            yield pd.DataFrame(rows, columns=["key", "png"])

    return images.select("key", "height", "width", "data").join(own, "key", "left").mapInPandas(draw, "key bigint, png binary")


def contact_sheets(images: DataFrame, batch: str = "batch", per_sheet: int = 60, tile: tuple[int, int] = (200, 207)) -> DataFrame:
    """(batch, sheet, png): the pictures of a batch in order of key, three in a row, shrunk to tiles; `per_sheet` pictures to a sheet.

    images: batch, key, height, width, data. A picture is shrunk where it is; a sheet is put together in one task.
    """
    from pyspark.sql import Window as W

    spark = images.sparkSession
    ship(spark)
    wide, high = tile

    def shrink(batches):
        import numpy as np
        import pandas as pd

        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
                except (ValueError, TypeError):
                    continue
                scale = min(1.0, (wide - 6) / r.width, (high - 6) / r.height)
                h, w = max(1, int(r.height * scale)), max(1, int(r.width * scale))
                small = image[(np.arange(h) * r.height // h)[:, None], np.arange(w) * r.width // w]
                rows.append((r.batch, r.key, h, w, small.tobytes()))
            yield pd.DataFrame(rows, columns=["batch", "key", "height", "width", "data"])

    small = images.select(F.col(batch).cast("string").alias("batch"), "key", "height", "width", "data").mapInPandas(shrink, "batch string, key bigint, height int, width int, data binary")
    placed = small.withColumn("n", F.row_number().over(W.partitionBy("batch").orderBy("key")) - 1).withColumn("sheet", F.floor(F.col("n") / per_sheet).cast("int"))

    def paste(group):
        import numpy as np
        import pandas as pd

        count = len(group)
        sheet = np.full((-(-count // 3) * high, 3 * wide, 3), 255, np.uint8)
        for i, r in enumerate(group.sort_values("n").itertuples(index=False)):
            y, x = i // 3 * high + (high - r.height) // 2, i % 3 * wide + (wide - r.width) // 2
            sheet[y : y + r.height, x : x + r.width] = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3)
        return pd.DataFrame({"batch": [group["batch"].iat[0]], "sheet": [group["sheet"].iat[0]], "png": [png(sheet)]})

    return placed.groupBy("batch", "sheet").applyInPandas(paste, "batch string, sheet int, png binary")


def write_collection(records: DataFrame, assets: DataFrame, root: str) -> None:
    """The training collection under root: assets once each, an annotation for each sample, picture and label of ready samples; those of others are removed.

    records: as build_records() gives them; assets: image_id, data as stored.
    """
    from plateworks.operators.training import yolo_text

    r = records.select("*", F.regexp_extract("image.collection_path", "(\\.[^./]*)$", 1).alias("_suffix"))
    write_files(r.select("image_id", F.col("image.collection_path").alias("name")).distinct().join(assets.select("image_id", "data"), "image_id").select("name", "data"), root)
    write_files(json_files(records, F.concat(F.lit("annotations/"), "sample_id", F.lit(".json"))), root)
    box = F.transform("panels", lambda p: F.struct(*[p["bbox_xyxy"][i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]))
    fit = r.where("ready_for_training")
    write_files(fit.select(F.concat(F.lit("ready/labels/"), "sample_id", F.lit(".txt")).alias("name"), yolo_text(box, F.col("image.width"), F.col("image.height")).cast("binary").alias("data")), root)
    write_files(fit.select("image_id", F.concat(F.lit("ready/images/"), "sample_id", "_suffix").alias("name")).join(assets.select("image_id", "data"), "image_id").select("name", "data"), root)
    gone = r.select("sample_id", "_suffix").distinct().join(fit.select("sample_id").distinct(), "sample_id", "left_anti")
    remove_files(gone.select(F.explode(F.array(F.concat(F.lit("ready/images/"), "sample_id", "_suffix"), F.concat(F.lit("ready/labels/"), "sample_id", F.lit(".txt")))).alias("name")), root)


def write_assets(images: DataFrame, path: str) -> None:
    """Image bytes once per content, by their digest, in partitions of the digest's first two digits."""
    rows = images.withColumn("image_id", F.concat(F.lit("img_"), F.sha2("data", 256))).dropDuplicates(["image_id"])
    rows.withColumn("shard", F.substring("image_id", 5, 2)).write.mode("append").partitionBy("shard").parquet(path)


def version_manifests(versions: DataFrame) -> DataFrame:
    """(job, record, label, manifest): the versions of each panel as one JSON text, oldest first."""
    entry = F.struct("version", "seq", "active")
    return versions.groupBy("job", "record", "label").agg(
        F.to_json(F.struct(F.max("version").alias("current_version"), F.array_sort(F.collect_list(entry)).alias("versions"))).alias("manifest")
    )


def overwrite_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replaces only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
