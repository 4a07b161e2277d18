"""Shared helpers: text columns, scratch tables in the cluster's shared folder, Arrow loops."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Hashable, Sequence
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Separators of plain words: blank, tab, LF, VT, FF, CR.
BLANKS = r"[\x20\x09-\x0D]+"
#: Separators of normalised words: every ASCII character that is no digit or lower-case letter.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def words_of(text: Column, separators: str = BLANKS) -> Column:
    """Words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators, -1), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset and driver and executors share a machine (tests) a local one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unclashed(keep: Sequence[str], *outputs: str) -> list[str]:
    """Columns of ``keep`` but for those that an output column of the same name replaces."""
    return [c for c in keep if c.lower() not in outputs]


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """The one large object (vocabulary, automaton) that a Python worker keeps for its next tasks; asking for another lets go of the last."""
    if key not in _held:
        let_go()
        _held[key] = make()
    return _held[key]


def let_go() -> None:
    """Frees what the worker keeps, for a task that needs no such object, and gives freed memory back to the system where it can."""
    _held.clear()
    gc.collect()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def text_key(doc_id: Column, text: Column) -> Column:
    """A key that equal rows share; used only where a clash of keys can't change a result."""
    return F.xxhash64(doc_id, text)


def row_key(doc_id: Column, text: Column) -> Column:
    """A key of 128 bits that only equal rows share."""
    return F.struct(F.xxhash64(doc_id, text).alias("a"), F.xxhash64(F.lit("second"), text, doc_id).alias("b"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors unless PYTHONPATH already leads their workers to it."""
    package = Path(__file__).resolve().parents[1]
    paths = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if package.parent in paths or app in _shipped:
        return
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))  # the driver serves it to every executor
    _shipped.add(app)


#: Most rows and bytes of an Arrow batch, for all operators alike; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def python_tasks(spark: SparkSession) -> None:
    """Readies Python workers: the package at hand, and Arrow batches that stay small beside an executor's memory."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
