"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: One word: a run of characters outside ASCII space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns of these names, compared as Spark compares them."""
    taken = {n.lower() for n in names}
    return df.select(*[column(c) for c in df.columns if c.lower() not in taken])


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared store that is no longer read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder, without its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows, and bytes of rows, that a worker has in hand as Python objects, about.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of bounded size, one row at least, so that long texts are not all unpacked at once."""
    for batch in batches:
        rows = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The series in parts of so many rows."""
    for batch in batches:
        for k in range(0, len(batch), BATCH_ROWS):
            yield batch.iloc[k : k + BATCH_ROWS]


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of any executor."""
    import shutil

    sc = spark.sparkContext
    if getattr(sc, "_lithospark_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    made = shutil.make_archive(
        os.path.join(tempfile.mkdtemp(prefix="lithospark-"), "lithospark"), "zip", root, "lithospark"
    )
    sc.addPyFile(made)
    sc._lithospark_shipped = True
