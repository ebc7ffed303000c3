"""Binary books: format routing and EPUB archives."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "path string, name string, content binary"


def book_format(path: Column, mime: Column | None = None) -> Column:
    """epub by name or type, else pdf."""
    epub = path.rlike(r"(?i)\.epub$")
    return F.when(epub if mime is None else epub | F.coalesce(mime == "application/epub+zip", F.lit(False)), "epub").otherwise("pdf")


def supported(path: Column, mime: Column | None = None) -> Column:
    named = path.rlike(r"(?i)\.(pdf|epub)$")
    return named if mime is None else named | F.coalesce(mime.isin("application/pdf", "application/epub+zip"), F.lit(False))


def read_files(spark: SparkSession, folder: str, glob: str = "*.epub") -> DataFrame:
    """path, content of the book files of a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")


def entries(files: DataFrame) -> DataFrame:
    """path, name, content of every stored or deflated file of each archive; other methods and broken archives have none."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    archive = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    continue
                rows += [(path, i.filename, archive.read(i)) for i in archive.infolist() if not i.is_dir() and i.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)]
            yield pd.DataFrame(rows, columns=["path", "name", "content"])

    return files.select("path", "content").mapInPandas(run, ENTRY)
