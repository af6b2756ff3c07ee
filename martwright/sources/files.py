"""CSV and JSON files, and the multi-table load."""

from __future__ import annotations

import time
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType, TimestampNTZType

from martwright.functions.text import DATE_FORMATS, lenient_date, null_tokens
from martwright.sources.schemas import RAW_TABLES, RawTables, with_load_ts
from martwright.sources import csv_records
from martwright.sources.tables import Versions, write_stable

# File formats of dates and timestamps.
DATE_FORMAT = "yyyy-MM-dd"
TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

LOAD_REPORT = "file string, table string, status string, rows bigint, elapsed double, error string"


def rename_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Apply the mapping; columns outside it become lower case."""
    return df.withColumnsRenamed({c: mapping.get(c, c.lower()) for c in df.columns})


def coerce_dates(df: DataFrame) -> DataFrame:
    """Read every text column with ``date`` in its name as a date, bad texts as null."""
    texts = [f.name for f in df.schema.fields if "date" in f.name.lower() and isinstance(f.dataType, StringType)]
    return df.withColumns({c: lenient_date(F.col(c), DATE_FORMATS) for c in texts})


def _cells(spark: SparkSession, path: str, multiline: bool) -> tuple[DataFrame, dict[str, list[str]], DataFrame]:
    """Cells by position (``c0``, ...) with their file, the distinct headers, and the header of every file.

    All headers come from one job, all cells from one scan, whatever the number of files.
    """
    ranges = write_stable(csv_records.ranges_of(spark, path), "ranges")
    headers = ranges.where("header is not null and trim(header) <> ''").select("file", "header")
    names = {r["header"]: csv_records.columns_of(r["header"]) for r in headers.select("header").distinct().collect()}
    width = max(map(len, names.values()), default=0)
    shape = StructType([StructField(f"c{i}", StringType()) for i in range(max(1, width))])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    if multiline:
        records = csv_records.without_headers(csv_records.records_of(spark, path, ranges), ranges)
        cells = records.select("file", F.from_csv("text", shape.simpleString()[7:-1].replace(":", " "), options).alias("r")).select("file", "r.*")
    else:
        reader = spark.read.schema(shape).options(header=True, enforceSchema=True, **options)
        cells = reader.csv(path).select(F.col("_metadata.file_path").alias("file"), "*")
    return cells, names, headers


def read_csv(
    spark: SparkSession,
    path: str,
    schema: StructType,
    mapping: Mapping[str, str] | None = None,
    multiline: bool = False,
    date_formats: tuple[str, ...] = DATE_FORMATS,
) -> DataFrame:
    """Typed CSV scan: header, quotes, null tokens; unreadable values become null.

    Every file's own header decides which column is which, so the columns may come in
    any order, and in another one in each file of a folder. ``schema`` names the result
    columns after renaming. Days are read in ISO form, else in the first of
    ``date_formats`` that fits. ``multiline`` reads quoted line breaks; a large file is
    still read by many tasks.
    """
    cells, names, headers = _cells(spark, path, multiline)
    required = {f.name for f in schema.fields if not f.nullable}
    places: dict[str, dict[str, int]] = {}
    for header, columns in names.items():
        named = [(mapping or {}).get(c, c.lower()) for c in columns]
        missing = [name for name in required if name not in named]
        if missing:
            raise ValueError(f"a file of {path} lacks the columns {sorted(missing)}")
        places[header] = {name: named.index(name) for name in schema.names if name in named}
    if not names and required:
        raise ValueError(f"{path} lacks the columns {sorted(required)}")
    if len(names) > 1:
        cells = cells.join(headers, "file")

    def text(name: str) -> Column:
        """The cell of a column, where the header of its file has it."""
        at = {header: place[name] for header, place in places.items() if name in place}
        if len(names) == len(at) and len(set(at.values())) == 1:
            return F.col(f"c{next(iter(at.values()))}")
        cell = F.lit(None).cast("string")
        for header, place in at.items():
            cell = F.when(F.col("header") == header, F.col(f"c{place}")).otherwise(cell)
        return cell

    return cells.select(*[_typed(f, text(f.name), date_formats) for f in schema.fields])


def _typed(field: StructField, cell: Column, date_formats: tuple[str, ...]) -> Column:
    text = null_tokens(cell)
    if isinstance(field.dataType, DateType):
        value = lenient_date(text, date_formats)
    elif isinstance(field.dataType, TimestampNTZType):
        value = text.try_cast("timestamp_ntz")
    elif isinstance(field.dataType, StringType):
        value = text
    else:
        value = text.try_cast(field.dataType)
    return value.alias(field.name)


def export_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with a header and without an index; null becomes an empty field."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer = writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    writer = writer.option("dateFormat", DATE_FORMAT).option("timestampNTZFormat", TIMESTAMP_FORMAT)
    if quote_all:
        writer = writer.option("quoteAll", True).option("emptyValue", "").option("nullValue", "")
    writer.csv(path)


def export_json(df: DataFrame, path: str) -> None:
    """One JSON object per line, null fields included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


@dataclass(frozen=True)
class Load:
    """One file of a load: where it is, where it goes, what it must look like."""

    path: str
    target: str
    schema: StructType
    expected: int | None = None
    multiline: bool = False


def load_all(spark: SparkSession, loads: Mapping[str, Load], mapping: Mapping[str, str] | None = None) -> DataFrame:
    """Refresh every table from its file and report per table.

    A file that is missing or unreadable, or leaves a required column empty, is
    reported as FAILED and does not stop the others. Tables are loaded side by side;
    rows and empty cells are counted while a version of the table is written. It takes
    the place of the version before only after its check, and at once; a table that
    fails keeps the rows it had.
    """

    def one(item: tuple[str, Load]) -> tuple:
        name, load = item
        started = time.monotonic()
        status, rows, error, version = "FAILED", 0, None, None
        versions = Versions(spark, load.target)
        try:
            counted = Observation(f"load_{name}")
            required = [f.name for f in load.schema.fields if not f.nullable]
            empty = [F.count_if(F.col(c).isNull()).alias(f"empty_{c}") for c in required]
            table = with_load_ts(read_csv(spark, load.path, load.schema, mapping, load.multiline))
            version = versions.write(table.observe(counted, F.count(F.lit(1)).alias("rows"), *empty))
            found = counted.get
            rows = found["rows"]
            broken = [c for c in required if found[f"empty_{c}"]]
            if broken:
                error = f"empty cells in the columns {broken}"
            else:
                versions.publish(version)
                status, version = "SUCCESS", None
                error = f"expected {load.expected} rows" if load.expected is not None and rows != load.expected else None
        except (PySparkException, ValueError) as problem:
            error = str(problem).splitlines()[0]
        if version:
            versions.discard(version)
        return load.path.rstrip("/").rsplit("/", 1)[-1], name, status, rows, time.monotonic() - started, error

    with ThreadPoolExecutor(max(1, len(loads))) as pool:
        return spark.createDataFrame(list(pool.map(one, loads.items())), LOAD_REPORT)


def csv_loads(folder: str, target: str) -> dict[str, Load]:
    """The five raw files of a folder and the tables they are loaded into."""
    return {name: Load(f"{folder}/{name}.csv", f"{target}/{name}", schema) for name, schema in RAW_TABLES.items()}


def loaded_tables(spark: SparkSession, target: str) -> RawTables:
    """The five raw tables as loaded."""
    return RawTables(**{name: Versions(spark, f"{target}/{name}").read() for name in RAW_TABLES})


def check_row_counts(tables: Mapping[str, DataFrame], expected: Mapping[str, int | None]) -> DataFrame:
    """Rows per table next to the expected number; a mismatch is only reported."""
    counts = None
    for name, df in tables.items():
        want = F.lit(expected.get(name)).cast("bigint")
        one = df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", want.alias("expected")
        )
        counts = one if counts is None else counts.unionByName(one)
    matches = F.col("expected").isNull() | (F.col("row_count") == F.col("expected"))
    return counts.withColumn("matches", matches)
