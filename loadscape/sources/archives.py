"""Readers of binary files: zip archives with their checksums, spreadsheets, numpy arrays.

Files are read by Spark's binaryFile source, one file a row, so many files are read by many tasks; a file itself is read
whole by one task (the source takes files of up to 2 GB).
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def zip_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, size, crc, intact, content) of every member of every archive.

    intact says whether the content has the stored CRC-32; content is null where it could not be unpacked at all.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"]):
                rows = []
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for m in (m for m in z.infolist() if not m.is_dir()):
                        try:
                            content = z.read(m)
                        except (zipfile.BadZipFile, zlib.error):
                            content = None
                        rows.append((where, m.filename, m.file_size, m.CRC, content is not None and zlib.crc32(content) == m.CRC, content))
                yield pd.DataFrame(rows, columns=["path", "name", "size", "crc", "intact", "content"])

    return _files(spark, path).mapInPandas(read, "path string, name string, size bigint, crc bigint, intact boolean, content binary")


def _column(reference: str) -> int:
    """Number from 0 of the column of a cell such as AB12."""
    n = 0
    for c in re.match("[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - ord("A") + 1
    return n - 1


def _cells(data: bytes, sheet: int) -> Iterator[tuple[int, int, str | None]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{_SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_SHEET}si")]
        with z.open(f"xl/worksheets/sheet{sheet}.xml") as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_SHEET}row":
                    continue
                for cell in row.iter(f"{_SHEET}c"):
                    value, kind = cell.findtext(f"{_SHEET}v"), cell.get("t")
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter(f"{_SHEET}t"))
                    yield int(row.get("r")), _column(cell.get("r")), value
                row.clear()


def spreadsheet_cells(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row, column, value as text) of every cell of a sheet of every workbook (the XML kind).

    Rows are numbered from 1 as in the file, columns from 0. Dates are serial numbers: see ``dialects.excel_serial``.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"]):
                found = pd.DataFrame(list(_cells(data, sheet)), columns=["row", "column", "value"])
                yield found.assign(path=where)[["path", "row", "column", "value"]]

    return _files(spark, path).mapInPandas(read, "path string, row int, `column` int, value string")


def numpy_rows(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, row, vals) of every row of every array of .npy and .npz files; an array of more dimensions is flattened within its rows."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, data in zip(batch["path"], batch["content"]):
                loaded = np.load(io.BytesIO(data), allow_pickle=False)
                for name, x in [*loaded.items()] if hasattr(loaded, "items") else [("", loaded)]:
                    x = np.asarray(x, float)
                    x = x.reshape(len(x), -1) if x.ndim else x.reshape(1, 1)
                    yield pd.DataFrame({"path": where, "name": name, "row": np.arange(len(x)), "vals": list(x)})

    return _files(spark, path).mapInPandas(read, "path string, name string, row bigint, vals array<double>")
