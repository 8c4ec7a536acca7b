"""Small files, written from rows and read into rows (reports, scripts, metadata)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlake.session import materialize

_OPEN_COST = "spark.sql.files.openCostInBytes"
SMALL_FILE_COST = 64 * 1024     # what a file counts beside its bytes: about 2000 small files make a task, not 32


def parsed_files(files: DataFrame, parse: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema) -> DataFrame:
    """Rows that ``parse`` takes from a scan of whole files.  The files are listed and read
    once, many to a task (and no more bytes to one than the session allows); the rows are stored."""
    spark = files.sparkSession
    before = spark.conf.get(_OPEN_COST)
    spark.conf.set(_OPEN_COST, str(SMALL_FILE_COST))
    try:
        return materialize(files.mapInPandas(parse, schema))
    finally:
        spark.conf.set(_OPEN_COST, before)


def write_files(rows: DataFrame, folder: str) -> int:
    """Write one file per row of (path, content, encoding) below a shared folder and
    return their number.  A task that runs again writes the same files again."""
    rows = rows.select("path", "content", "encoding")
    tasks = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < tasks:      # writing files takes far longer than making their rows
        rows = rows.repartition(tasks)

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        made = set()
        for pdf in batches:
            for path, content, encoding in zip(pdf["path"], pdf["content"], pdf["encoding"]):
                store, target = fs.FileSystem.from_uri(f"{folder}/{path}") if "://" in folder else \
                    (fs.LocalFileSystem(), f"{folder.removeprefix('file:')}/{path}")
                parent = target.rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(target) as out:
                    out.write(content.encode(encoding))
            yield pd.DataFrame({"n": [len(pdf)]})

    return rows.mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0
