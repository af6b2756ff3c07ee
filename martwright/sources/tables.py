"""Written tables: full refresh, views, clustered layout, stable intermediates."""

from __future__ import annotations

import gc
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from martwright.session import shared_folder


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Hand the rows of a few-task scan to all cores before row-wise work.

    A file with one row group is read by one task, however many cores there are. A
    scan that has a task per core stays as it is, so a large table never pays for
    this exchange. ``by`` should tell rows apart.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *by)


def write_full_refresh(df: DataFrame, target: str, as_table: bool = False) -> None:
    """Replace the target with the rows of ``df``; running it again changes nothing."""
    if as_table:
        df.write.mode("overwrite").saveAsTable(target)
    else:
        df.write.mode("overwrite").parquet(target)


class Versions:
    """A table of which readers see one whole version at a time.

    A version is written beside the others. Publishing it is one rename of a small file
    that names it, numbered one above the last; it fails if another writer was first.
    Readers take the highest number. What is not published is never read.
    """

    def __init__(self, spark: SparkSession, target: str):
        self.spark, self.target = spark, target.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.target).getFileSystem(spark._jsc.hadoopConfiguration())

    def write(self, df: DataFrame) -> str:
        """Write a version and return its name; nobody reads it yet."""
        name = f"data-{uuid.uuid4().hex[:12]}"
        df.write.parquet(f"{self.target}/{name}")
        return name

    def numbers(self) -> list[int]:
        """Published numbers, the current one last."""
        folder = self.path(f"{self.target}/published")
        if not self.files.exists(folder):
            return []
        return sorted(int(f.getPath().getName()) for f in self.files.listStatus(folder) if f.getPath().getName().isdigit())

    def _name(self, number: int) -> str:
        return self.spark.read.text(f"{self.target}/published/{number:010d}").first()[0]

    def publish(self, name: str) -> int:
        """Make a written version the current one; returns its number."""
        number = (self.numbers() or [0])[-1] + 1
        self.files.mkdirs(self.path(f"{self.target}/published"))
        draft, place = self.path(f"{self.target}/.draft-{name}"), self.path(f"{self.target}/published/{number:010d}")
        out = self.files.create(draft, True)
        out.write(bytearray(name, "utf-8"))
        out.close()
        if self.files.exists(place) or not self.files.rename(draft, place):
            self.files.delete(draft, False)
            raise ValueError(f"{self.target} has been published by another writer")
        return number

    def read(self, number: int | None = None) -> DataFrame:
        """The current version, or an earlier one."""
        number = number or (self.numbers() or [0])[-1]
        if not number:
            raise ValueError(f"{self.target} has no published version")
        return self.spark.read.parquet(f"{self.target}/{self._name(number)}")

    def discard(self, name: str) -> None:
        """Delete a version that will not be published."""
        remove_folder(self.spark, f"{self.target}/{name}")

    def drop_old(self, keep: int = 2) -> None:
        """Delete all but the last published versions; readers of an older one lose it."""
        for number in self.numbers()[:-keep]:
            name = self._name(number)
            self.files.delete(self.path(f"{self.target}/published/{number:010d}"), False)
            self.discard(name)


def materialize(df: DataFrame, name: str, kind: str = "view") -> DataFrame:
    """Register as a temporary view or save as a table, and read it back."""
    if kind == "view":
        df.createOrReplaceTempView(name)
    elif kind == "table":
        df.write.mode("overwrite").saveAsTable(name)
    else:
        raise ValueError(f"unknown materialization {kind!r}")
    return df.sparkSession.table(name)


# Bits of a column's place in a curve over two columns.
CURVE_BITS = 16


def _place(column: Column, low: Column, high: Column) -> Column:
    """Where a value lies between the bounds, as a number of ``CURVE_BITS`` bits; nulls and what lies below come first."""
    part = (column - low).cast("double") / F.greatest((high - low).cast("double"), F.lit(1.0))
    most = (1 << CURVE_BITS) - 1
    return F.coalesce(F.least(F.greatest(F.floor(part * most), F.lit(0)), F.lit(most)), F.lit(0)).cast("long")


def _spread(bits: Column) -> Column:
    """The bits of a number with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        bits = bits.bitwiseOR(F.shiftleft(bits, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return bits


def curve(first: tuple[Column, Column, Column], second: tuple[Column, Column, Column]) -> Column:
    """Place on a curve that runs through both columns alike: their bits by turns.

    A column comes with its bounds. Rows that are near on the curve are near in both
    columns, so the minima and maxima of a stretch are narrow in each of them.
    """
    return F.shiftleft(_spread(_place(*first)), 1).bitwiseOR(_spread(_place(*second)))


def curve_clustered(df: DataFrame, place: Column) -> DataFrame:
    """Rows arranged along a curve, so that statistics of files and row groups can skip by either of its columns.

    Cells of the curve, about one per shuffle partition, are shuffled once without a
    sampling pass; adaptive execution splits a hot cell and merges small ones. Inside a
    task the rows follow the curve.
    """
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, width.bit_length() - 1) // 2 * 2
    dealt = df.withColumn("_cell", F.shiftright(place, 2 * CURVE_BITS - bits)).hint("rebalance", "_cell").drop("_cell")
    return dealt.withColumn("_curve", place).sortWithinPartitions("_curve").drop("_curve")


def write_stable(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write once under a fresh name in the shared folder and read it back.

    Cuts the lineage: a lost executor re-reads files instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{folder or shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def collect_garbage(spark: SparkSession) -> None:
    """Have the shuffle files of finished work removed.

    Spark removes them when the driver's memory is cleared of what they belonged to; with
    memory to spare that may be long after, and all that was shuffled stays on the disks.
    """
    gc.collect()
    spark._jvm.System.gc()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of written tables in whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fingerprint(spark: SparkSession, paths: list[str]) -> tuple:
    """State of the files below the paths: it changes when any of them does.

    Paths this process can see are looked up directly, others by a Spark listing that
    reads no file contents.
    """
    if all(os.path.exists(path) for path in paths):
        files = [f for path in paths for f in ([path] if os.path.isfile(path) else [e.path for e in os.scandir(path)])]
        return tuple((f, os.stat(f).st_size, os.stat(f).st_mtime_ns) for f in sorted(files))
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(paths)
        .selectExpr("count(*)", "sum(length)", "max(modificationTime)")
    )
    return tuple(listed.first())
