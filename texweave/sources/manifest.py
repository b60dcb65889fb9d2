"""JSON-Lines manifests of formula records."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

MANIFEST = StructType([StructField(n, StringType()) for n in ("id", "image", "raw_latex", "subset", "source")])
REQUIRED = ("image", "id", "raw_latex")


def resolve(image: Column, base: str) -> Column:
    """Relative paths are joined to the manifest's folder, absolute ones stay; ``..`` is kept."""
    return F.when(F.startswith(image, F.lit("/")), image).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), image))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Fast scan with a fixed schema: blank lines are skipped, other keys ignored, columns pruned by Spark."""
    rows = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path)
    return rows.select("id", resolve(F.col("image"), str(PurePosixPath(path).parent)).alias("image_path"), "raw_latex", "subset", "source")


def parse_line(line: str, number: int) -> dict | None:
    """One line as a record, with values turned into text as the format has it; None for a blank line.

    Raises ValueError naming the line for anything but an object, and for a
    missing key or an empty id.
    """
    if not line.strip():
        return None
    value = json.loads(line)
    if not isinstance(value, dict):
        raise ValueError(f"line {number}: a JSON object is required")
    missing = [k for k in REQUIRED if k not in value]
    if missing:
        raise ValueError(f"line {number}: missing field {missing[0]!r}")
    record = {"id": str(value["id"]), "image": str(value["image"]), "raw_latex": str(value["raw_latex"])}
    record |= {k: None if value.get(k) is None else str(value[k]) for k in ("subset", "source")}
    if not record["id"]:
        raise ValueError(f"line {number}: id must not be empty")
    return record


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """Scan that keeps line numbers and raises on the first bad line of a file (read whole by one task)."""
    base = str(PurePosixPath(path).parent)

    def run(batches):
        import pandas as pd

        for b in batches:
            for text in b["value"]:
                found = [(n, parse_line(x, n)) for n, x in enumerate(text.split("\n"), 1)]
                rows = [(n, r["id"], r["image"], r["raw_latex"], r["subset"], r["source"]) for n, r in found if r is not None]
                yield pd.DataFrame(rows, columns=["line", "id", "image", "raw_latex", "subset", "source"])

    schema = "line long, id string, image string, raw_latex string, subset string, source string"
    rows = spark.read.text(path, wholetext=True).mapInPandas(run, schema)
    return rows.select("line", "id", resolve(F.col("image"), base).alias("image_path"), "raw_latex", "subset", "source")


def records(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """An in-memory source; ids must not be empty."""
    if any(not r["id"] for r in rows):
        raise ValueError("id must not be empty")
    schema = "id string, image_path string, raw_latex string, subset string, source string"
    return spark.createDataFrame([(r["id"], r.get("image_path"), r["raw_latex"], r.get("subset"), r.get("source")) for r in rows], schema)


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of manifests as a stream."""
    rows = spark.readStream.schema(MANIFEST).json(folder)
    return rows.select("id", resolve(F.col("image"), folder).alias("image_path"), "raw_latex", "subset", "source")
