"""What the operators share: tables, and functions over Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.text import CHUNK_BYTES, Chunk, chunks
from kinmatch.operators.graph import saved, shared_folder

__all__ = ["free_name", "given_back", "map_texts", "one_blas_thread", "quoted", "removed", "saved", "small_batches", "stored", "table", "whole"]

#: Bytes of an Arrow batch, about: 10,000 texts are 35 MB, which executor and Python worker hold more than once.
BATCH_BYTES = 4 << 20
#: Bytes of text in a chunk where nothing is summed up over it.
SMALL_CHUNK = 1 << 18


@lru_cache(maxsize=1)
def one_blas_thread() -> None:
    """Products of this process run on one thread: a task has one core, and more threads only wait for each other.

    Where numpy comes without a library of its own, nothing is changed.
    """
    for lib in sorted(Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*")):
        blas = ctypes.CDLL(str(lib))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(blas, name):
                getattr(blas, name)(ctypes.c_int(1))
                return


def given_back() -> None:
    """Memory that a task has freed goes back to the system: a Python worker stays when its task ends, and its executor's others need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are bounded by bytes too, unless the user has set a bound."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as Parquet in a new folder of the shared one, read again, and that folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """The folder goes."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def whole(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name of theirs meets one of an operator's."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)) if df.columns else F.struct(F.lit(None).alias("none"))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def free_name(name: str, taken: list[str]) -> str:
    """name, or with as many underscores after it as make it none of taken, in any case of letters."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def map_texts(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[pa.RecordBatch, Chunk], pa.RecordBatch | None]],
    schema: str,
    through: Callable[[np.ndarray], np.ndarray] | None = None,
    inside: str | None = None,
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """df through make()(rows, chunk) for every chunk of texts of about `limit` bytes; make runs once for each task. inside: the struct that has the text."""
    small_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        batch = texts = chunk = out = None
        for batch in batches:
            texts = batch.column(inside).field(text) if inside else batch.column(text)
            for chunk in chunks(texts, through, limit):
                out = fn(batch.slice(chunk.rows.start, chunk.rows.stop - chunk.rows.start), chunk)
                if out is not None and out.num_rows:
                    yield out
        del fn, batch, texts, chunk, out
        given_back()

    return df.mapInArrow(run, schema)
