"""Helpers shared by the training-data operators: whole texts, shared scratch tables, files in the shared folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application (as ``--py-files`` would)."""
    sc = spark.sparkContext
    if getattr(sc, "_flipwise_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as folder:
        copy = shutil.copytree(package, f"{folder}/flipwise", ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        kept = tempfile.mkdtemp(prefix="flipwise-py-")  # the driver serves it from here
        sc.addPyFile(shutil.make_archive(f"{kept}/flipwise_package", "zip", folder, os.path.basename(copy)))
    sc._flipwise_shipped = True


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package importable on every executor."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str | Column = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("string")


def row_of(docs: DataFrame) -> Column:
    """The whole input row as one struct: columns computed beside it cannot meet the input's names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores behind it while the input has a column of that name (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Scratch folders of this process, per application.
_SCRATCH: dict[str, list[str]] = {}


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's reliable checkpoint folder (``spark.checkpoint.dir`` on a cluster)."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def clear_scratch(spark: SparkSession) -> int:
    """Delete the scratch folders of this application; returns how many.  DataFrames that read them fail afterwards."""
    folders = _SCRATCH.pop(spark.sparkContext.applicationId, [])
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{scratch_folder(df.sparkSession, name)}/t.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI, usable by driver and executors alike (file, hdfs, s3, gs)."""
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        uri = "file://" + uri
    return pafs.FileSystem.from_uri(uri)


def write_atomically(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    """Write one file under a name that no other attempt uses, then move it to its final name.

    A retried or speculative attempt passes another ``name``, so a reader that
    follows the manifest only ever sees whole files.
    """
    filesystem, path = open_folder(folder)
    filesystem.create_dir(path, recursive=True)
    part = f"{path}/.{name}.part"
    with filesystem.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    filesystem.move(part, f"{path}/{name}")


def runs(items: Iterator, size: Callable, most: int) -> Iterator[Iterator]:
    """Consecutive runs of ``items``, each ending once its sizes reach ``most``; use up a run before asking for the next."""
    def run(first):
        held = 0
        for item in chain([first], items):
            held += size(item)
            yield item
            if held >= most:
                return

    for first in items:
        yield run(first)


def byte_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, length) of consecutive runs of rows with about ``most`` bytes of text each."""
    start = held = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if held and held + n > most:
            yield start, i - start
            start, held = i, 0
        held += n
    if len(texts) > start:
        yield start, len(texts) - start
