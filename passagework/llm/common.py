"""What the operators of this package share."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

CUT_BYTES = 4 << 20  # a long text is split into words by pieces of this size
SPACE = re.compile(rb"[ \t-\r]")
SLICE_BYTES = 16 << 20  # text bytes that a Python task works on at once


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A folder for this application in the shared folder of the cluster.

    That is ``spark.checkpoint.dir``; only where it is unset (one machine, tests) the
    warehouse takes its place.  What is written there may be deleted when the
    application has ended.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/passagework-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back.

    This cuts the lineage: what was computed survives a lost executor and is
    computed once, however often it is read.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table of a frame that :func:`stored` has returned; nothing may read it any more."""
    folders = {file.rsplit("/", 1)[0] for file in df.inputFiles()}
    jvm = df.sparkSession._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Inside, the shuffle files of a query go when it has ended: all it gives is stored by then."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns that have one of ``names`` in any case."""
    taken = {name.lower() for name in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken])


def add_columns(
    df: DataFrame,
    new: list[T.StructField],
    work: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]],
    leave_out: tuple[str, ...] = (),
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Append columns that ``work`` computes for slices of the rows; narrow, nothing is shuffled.

    ``work`` gets the slices and yields for each one array per new column.  Columns
    of ``df`` that have the name of a new one are replaced.  Columns in ``leave_out``
    are read but not returned.
    """
    rest = without(df, [f.name for f in new])
    kept = [i for i, f in enumerate(rest.schema.fields) if f.name not in leave_out]
    schema = T.StructType([rest.schema.fields[i] for i in kept] + new)
    wanted = to_arrow_schema(schema)

    def run(batches):
        seen = []

        def slices():
            for batch in batches:
                for piece in text_slices(batch, slice_bytes):
                    seen.append(piece)
                    yield piece

        try:
            for arrays in work(slices()):
                piece = seen.pop(0)
                columns = [piece.column(i) for i in kept] + arrays
                yield pa.RecordBatch.from_arrays(
                    [c if c.type == f.type else c.cast(f.type) for c, f in zip(columns, wanted)], schema=wanted
                )
        finally:
            release()

    return rest.mapInArrow(run, schema)


def release() -> None:
    """Give back what a task has held: its worker goes on to serve tasks of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()


def text_slices(batch: pa.RecordBatch, slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of a batch that hold about ``slice_bytes`` each, or a single larger row."""
    if batch.num_rows == 0:
        return
    step = max(1, int(batch.num_rows * min(1.0, slice_bytes / max(1, batch.nbytes))))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def word_lists(text: bytes | None) -> Iterator[list[bytes]]:
    """The words between ASCII white space, in lists of bounded size."""
    at = 0
    while text and at < len(text):
        cut = SPACE.search(text, at + CUT_BYTES)
        end = cut.start() if cut else len(text)
        yield text[at:end].split()
        at = end
