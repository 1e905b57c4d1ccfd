"""A data source of page objects: `spark.read.format("page_objects").load(folder)`.

Each file is one partition. JSON files hold one block a line; PDF files are read if the optional reader is
installed, and are an error in the row otherwise, so that one bad file doesn't end a job.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "pdf string, page_number int, block_index int, kind string, text string, x0 double, y0 double, x1 double, y1 double, font_size_pt double, "
    "font_name string, bold boolean, error string"
)
FIELDS = [c.split()[0] for c in SCHEMA.split(", ")]


class PageObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> "PageReader":
        return PageReader(self.options["path"])


class PageReader(DataSourceReader):
    def __init__(self, root: str) -> None:
        self.root = root

    def partitions(self) -> list[InputPartition]:
        found = [os.path.join(d, f) for d, _, fs in os.walk(self.root) for f in fs if f.lower().endswith((".json", ".jsonl", ".pdf"))]
        return [InputPartition(p) for p in sorted(found)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        path = partition.value
        name = os.path.basename(path)
        if path.lower().endswith(".pdf"):
            yield from self._pdf(path, name)
            return
        with open(path, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    try:
                        row = json.loads(line)
                        yield tuple(row.get(c, name if c == "pdf" else None) for c in FIELDS)
                    except ValueError as e:
                        yield (name, *[None] * (len(FIELDS) - 2), str(e))

    @staticmethod
    def _pdf(path: str, name: str) -> Iterator[tuple]:
        try:
            import fitz
        except ImportError:
            yield (name, *[None] * (len(FIELDS) - 2), "no PDF reader is installed")
            return
        with fitz.open(path) as doc:
            for page in doc:
                for b in page.get_text("dict")["blocks"]:
                    spans = [s for ln in b.get("lines", []) for s in ln["spans"]]
                    words = " ".join(" ".join(s["text"] for s in spans).split())
                    n = sum(len(s["text"]) for s in spans)
                    size = sum(s["size"] * len(s["text"]) for s in spans) / n if n else None
                    top = max(spans, key=lambda s: len(s["text"]), default=None)
                    yield (
                        name, page.number + 1, b["number"], "image" if b["type"] == 1 else "text", words, *map(float, b["bbox"]), size,
                        top["font"] if top else None, bool(top and "bold" in top["font"].lower()), None,
                    )


def register(spark) -> None:
    spark.dataSource.register(PageObjects)
