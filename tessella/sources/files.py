"""Keyed datasets in files: CSV read strictly, Parquet, Excel."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataError
from .excel import read_sheet

FORMATS = ("csv", "parquet", "xlsx", "xlsm")


def checked_header(names: Sequence[str | None], what: str) -> list[str]:
    """SRC5: the names, or a DataError if one is empty or two are equal but for case."""
    out = [(n or "").removeprefix("﻿") for n in names]
    if not out or any(not n.strip() for n in out):
        raise DataError(f"{what}: a column has no name")
    seen: dict[str, str] = {}
    for n in out:
        if n.lower() in seen:
            raise DataError(f"{what}: column {n!r} stands twice" + (f" (also as {seen[n.lower()]!r})" if seen[n.lower()] != n else ""))
        seen[n.lower()] = n
    return out


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """SRC1: a CSV with header as string columns, empty cells as ''. Rows of the wrong length fail when they are read.

    A distributed look at the quotes finds a quote that is never closed, and whether any value goes over
    several lines; only then the file can't be split among tasks.
    """
    try:
        lines = spark.read.text(path)
        quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
        look = lines.groupBy(F.col("_metadata.file_path")).agg((F.sum(quotes) % 2).alias("odd"), F.max(quotes % 2).alias("over")).agg(F.max("odd").alias("odd"), F.max("over").alias("over")).first()
    except AnalysisException as e:
        raise DataError(f"{path} can't be read: {str(e).splitlines()[0]}") from None
    if look["odd"] is None:
        raise DataError(f"{path}: the file is empty")
    if look["odd"]:
        raise DataError(f"{path}: a quote is never closed")
    reader = spark.read.options(sep=delimiter, quote='"', escape='"', multiLine=bool(look["over"]), mode="FAILFAST", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, encoding="UTF-8")
    first = reader.option("header", False).csv(path).limit(1).collect()
    names = checked_header(list(first[0]), path)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    frame = reader.option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    return frame.select(*[F.coalesce(F.col(f"`{n.replace('`', '``')}`"), F.lit("")).alias(n) for n in names])


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """SRC4: a sheet (the first if none is named) as string columns; empty cells are null."""
    header, rows = read_sheet(path, sheet)
    names = checked_header([(h or "").strip() for h in header], path)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    return spark.createDataFrame([tuple((*r, *[None] * len(names))[: len(names)]) for r in rows], schema)


def resolved(file: str, base: str | Path) -> str:
    """A path or URL of an input; relative ones start at the specification's folder."""
    return file if "://" in file or Path(file).is_absolute() else str(Path(base) / file)


def format_of(endpoint: Mapping) -> str:
    kind = endpoint.get("format") or endpoint["file"].rstrip("/").rsplit(".", 1)[-1].lower()
    if kind not in FORMATS:
        raise DataError(f"{endpoint['file']}: format {kind!r} is not one of {', '.join(FORMATS)}")
    return kind


def read_file(spark: SparkSession, endpoint: Mapping, base: str | Path = ".") -> DataFrame:
    """SRC6: the dataset of a file endpoint."""
    path, kind = resolved(endpoint["file"], base), format_of(endpoint)
    if "://" not in path and not Path(path).exists():
        raise DataError(f"{path}: no such file")
    if kind == "csv":
        return read_csv(spark, path, endpoint.get("delimiter", ","))
    if kind == "parquet":
        frame = spark.read.parquet(path)
        checked_header(frame.columns, path)
        return frame
    return read_excel(spark, path, endpoint.get("sheet"))


def fingerprint(path: str) -> str | None:
    """SRC16: SHA-256 of a file; of a folder, over the names and hashes of its files; none for remote paths."""
    if "://" in path:
        return None
    p = Path(path)
    if p.is_dir():
        inner = [f"{f.relative_to(p)} {fingerprint(str(f))}" for f in sorted(p.rglob("*")) if f.is_file() and not f.name.startswith((".", "_"))]
        return hashlib.sha256("\n".join(inner).encode()).hexdigest()
    with p.open("rb") as handle:
        return hashlib.file_digest(handle, "sha256").hexdigest()
