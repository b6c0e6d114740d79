"""Session plumbing shared by every operator: the shared folder, staged tables, code shipping."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}
_STAGED: dict[str, list[str]] = {}
_BATCH_KEY, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4194304b"
#: Bytes of a staged file's row groups: a file that one task wrote can be read by several.
_ROW_GROUP = 8 << 20
#: Rows that a scan decodes at once, in one array a column: 4096 long texts are tens of MB that a heap has to find in one piece.
_SCAN_KEY, _SCAN_ROWS = "spark.sql.parquet.columnarReaderBatchSize", "256"
_CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only on a local master that leaves it unset (tests, a laptop) is a temporary folder made; elsewhere that is an
    error, as executors would not see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(_LOCAL[app])
    return _LOCAL[app]


def clean(spark: SparkSession) -> None:
    """Delete what this session's queries have staged. Results that weren't written or collected yet can't be read after."""
    for path in _STAGED.pop(spark.sparkContext.applicationId, []):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def ship(spark: SparkSession) -> None:
    """Give the Python workers this package, wherever the driver was started from."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(_BATCH_KEY) != _BATCH_BYTES:
        spark.conf.set(_BATCH_KEY, _BATCH_BYTES)  # long texts: a worker holds batches by bytes, not by rows
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="sparkloom-ship-"), "sparkloom.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("sparkloom", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def give_back() -> None:
    """Return a Python worker's freed memory to the system; workers are kept and share an executor's limit."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not glibc


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """Scans planned meanwhile decode few rows at once; for those of whole texts."""
    before = spark.conf.get(_SCAN_KEY)
    spark.conf.set(_SCAN_KEY, _SCAN_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_SCAN_KEY, before)


class Scratch:
    """Tables one query writes to the shared folder to cut lineage; a lost executor rereads them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.path = f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _STAGED.setdefault(spark.sparkContext.applicationId, []).append(self.path)

    @contextmanager
    def _tidy(self) -> Iterator[None]:
        """Shuffle files of a write go when it has ended: what it wrote is read from then on."""
        before = self.spark.conf.get(_CLEAN_KEY, "false")
        self.spark.conf.set(_CLEAN_KEY, "true")
        try:
            yield
        finally:
            self.spark.conf.set(_CLEAN_KEY, before)

    def stage(self, df: DataFrame, compression: str = "zstd", slim: bool = False) -> DataFrame:
        """Write a table now and read it back. ``slim``: rows are few bytes each of a large scan, and go to files of an even size instead of one for each split."""
        df = df.hint("rebalance") if slim else df
        self._n += 1
        path = f"{self.path}/t{self._n}"
        with self._tidy():
            df.write.option("compression", compression).option("parquet.block.size", _ROW_GROUP).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._staged_path = path
        return out

    def stage_by(self, df: DataFrame, key: str, buckets: int, compression: str = "zstd") -> DataFrame:
        """Write a table bucketed by ``key``: joins and groups on it don't move its rows again."""
        self._n += 1
        name = f"loom_{uuid.uuid4().hex}"
        with self._tidy():
            df.write.bucketBy(buckets, key).option("compression", compression).option("path", f"{self.path}/t{self._n}").saveAsTable(name)
        out = self.spark.table(name)
        out.schema  # resolved now, with its buckets
        self.spark.sql(f"DROP TABLE {name}")  # the files stay: it has a path of its own
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a staged table that no later plan reads."""
        path = getattr(df, "_staged_path", None)
        if path:
            _delete(self.spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
