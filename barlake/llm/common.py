"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlake.session import ensure_checkpoint_dir

#: Word separators: space, tab, line feed, vertical tab, form feed, return.
SEPARATORS = " \t\n\x0b\f\r"
_SEPARATOR_RUN = "[\\x20\\x09-\\x0D]+"

_made: dict[str, list[tuple[SparkSession, str]]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    app = spark.sparkContext.applicationId
    if app not in _made:
        _made[app] = []
        atexit.register(_clear, app)
    _made[app].append((spark, path))
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch path that no live DataFrame reads any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    made = _made.get(spark.sparkContext.applicationId, [])
    made[:] = [m for m in made if m[1] != path]


def _clear(app: str) -> None:
    for spark, path in list(_made.pop(app, [])):
        try:
            if spark._jsc.sc().isStopped():
                return
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
        except Exception:  # noqa: BLE001  the session is already gone at interpreter exit
            return


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: it survives lost
    executors and is read back column by column."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).alias(name)


def words_of(text: Column) -> Column:
    """Array of the words of a text (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _SEPARATOR_RUN), "")


def let(value: Column, body) -> Column:
    """Bind ``value`` once as a lambda variable and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def slices(batches, column: str, budget: int = 4 << 20):
    """Cut Arrow batches into slices of about ``budget`` bytes of ``column`` (one
    row at least), so that what a task holds does not depend on the row count."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size.astype(np.int64)) // budget
        starts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(starts, starts[1:]):
            yield batch.slice(lo, hi - lo)


def byte_texts(batch, column: str) -> list[bytes]:
    """The texts of a batch as UTF-8 (null: empty)."""
    import pyarrow as pa

    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]
