"""Tables that cut lineage, written to the folder all machines share.

``spark.checkpoint.dir`` names that folder.  Only in local mode, where there is
one machine, a temporary folder stands in for it if it is unset.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []
_lasting: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; on a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="lanternfish-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    ``lasting`` tables outlive the ``passing`` block in which they are written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lanternfish-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    if lasting:
        _lasting.add(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing(spark: SparkSession):
    """Tables written within are deleted at the end, but for the lasting ones."""
    start = mark()
    try:
        yield
    finally:
        _delete(spark, [p for p in _written[start:] if p not in _lasting])
        _written[start:] = [p for p in _written[start:] if p in _lasting]


#: Bytes sent at once to a Python worker, about, within ``small_batches``.
_BATCH_BYTES = 8 << 20
_BYTES_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on the session sends at most about 8 MB at once to Python workers.

    For results that are evaluated after their operator has returned.  Every
    task has a few batches outside the heap, which executors keep.
    """
    spark.conf.set(_BYTES_KEY, str(_BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession):
    """Within, actions send bounded bytes at once to Python workers, however long the rows.

    The number of rows a batch stays as it is: workers of another number are
    another pool, and executors would keep both.
    """
    before = spark.conf.get(_BYTES_KEY)
    bound_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BYTES_KEY, before)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column name with its dots and backticks taken literally."""
    return "`" + name.replace("`", "``") + "`"


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs``, written once, with a number for each row in a column of a new name."""
    name = unused(docs, "row_no")
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "numbered", lasting=True), name


def without(rows: DataFrame, number: str, dropped: DataFrame) -> DataFrame:
    """``rows`` without those in ``dropped`` (one column of numbers), and without the number.

    The numbers are written first, so Spark knows their size: few are sent to
    the rows, many are met by a join that moves each row once.
    """
    gone = materialize(dropped.toDF(number), "dropped", lasting=True)
    return rows.join(gone, number, "left_anti").drop(number)


def mark() -> int:
    """A point in the list of tables written so far, for ``release``."""
    return len(_written)


def release(spark: SparkSession, since: int = 0, until: int | None = None) -> None:
    """Delete tables written between two marks; their readers must be done."""
    _delete(spark, _written[since:until])
    _written[since:until] = []


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _lasting.discard(path)
