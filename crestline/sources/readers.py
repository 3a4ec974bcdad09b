"""Readers for landed files; every stage after the first reads Parquet."""

from __future__ import annotations

import hashlib
import json
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Name and width of each field of the population file.
POPULATION_FIELDS = [
    ("year", 4), ("state_abbr", 2), ("state_fips", 2), ("county_fips3", 3), ("registry", 2),
    ("race", 1), ("origin", 1), ("sex", 1), ("age", 2), ("population", 8),
]


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Headed CSV under an explicit schema; cells that do not parse become NULL."""
    return (
        spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    )


def read_paged_csv(spark: SparkSession, directory: str, columns: list[str]) -> DataFrame:
    """All landed pages of one feed, as text columns; a record is a line.

    The pages are read once, as text.  Their header lines are left out and every other line is
    parsed by the columns given.  A page that holds HTML instead (an error page, say) fails the read with its name.
    """
    lines = spark.read.text(directory).select("value", F.input_file_name().alias("_file"))
    start = F.ltrim(F.lower("value"))
    bad = start.startswith("<html") | start.startswith("<!doctype")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("page is HTML, not CSV: "), F.col("_file"))).cast("string")).otherwise(F.col("value"))
    schema = StructType([StructField(c, StringType()) for c in columns])
    header = ",".join(columns).lower()
    named = F.lower(F.regexp_replace("line", r'["\s\uFEFF]', ""))
    rows = lines.select(checked.alias("line")).where((named != header) & (named != ""))
    return rows.select(F.from_csv("line", schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ")).alias("r")).select("r.*")


def read_fixed_width(
    spark: SparkSession, path: str, fields: list[tuple[str, int]] = POPULATION_FIELDS
) -> DataFrame:
    """Fixed-width text (plain or gzip), each field trimmed, blank fields NULL."""
    return split_fixed_width(spark.read.text(path), fields)


def split_fixed_width(
    lines: DataFrame, fields: list[tuple[str, int]], column: str = "value"
) -> DataFrame:
    cols, start = [], 1
    for name, width in fields:
        cell = F.trim(F.substring(column, start, width))
        cols.append(F.nullif(cell, F.lit("")).alias(name))
        start += width
    return lines.select(*cols)


def fingerprint(df: DataFrame, parameters: dict | None = None) -> str:
    """What a stage was made from: schema, parameters, the plan's own text, and name, size and time of every input file."""
    spark = df.sparkSession
    files = []
    for path in sorted({str(PurePosixPath(unquote(f)).parent) for f in df.inputFiles()}):
        seen = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
        files += [[r["path"], r["length"], str(r["modificationTime"])] for r in seen.collect()]
    made = {"schema": df.schema.jsonValue(), "parameters": parameters or {}, "files": sorted(files)}
    return hashlib.sha256(json.dumps(made, sort_keys=True, default=str).encode()).hexdigest()


def stage(df: DataFrame, path: str, parameters: dict | None = None) -> DataFrame:
    """Write a stage table once and read it back.

    A stage whose manifest has the same fingerprint is reused; one with another, or that was not
    written to its end, is written anew.  Each version has a folder of its own, and the manifest is
    written last, so readers of an earlier version keep their files.  A plan's constants are no part of the
    fingerprint: pass what they depend on as ``parameters``.
    """
    spark = df.sparkSession
    mark = fingerprint(df, parameters)
    version = f"{path}/{mark[:16]}"
    manifest = f"{path}/manifest-{mark[:16]}"
    try:
        done = spark.read.json(manifest, "fingerprint string").first()
    except AnalysisException:  # no manifest yet
        done = None
    if done is None or done["fingerprint"] != mark:
        df.write.mode("overwrite").parquet(version)
        spark.createDataFrame([(mark,)], "fingerprint string").coalesce(1).write.mode("overwrite").json(manifest)
    return spark.read.schema(df.schema).parquet(version)
