"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: maximal runs of characters other than ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: Words of the contracts that also end at ASCII punctuation (after lower-casing A-Z).
TEXT_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# functions go to executors with their code, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules["quernstone"])

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_written: dict[str, SparkSession] = {}
_outliving: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a
    local master only, a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quernstone-')}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str, outlive: bool = False) -> DataFrame:
    """Cut lineage: write the rows once to the shared folder and read them again, so
    that a lost executor costs no recomputation and several consumers one scan. The files go
    when the process ends, or with the block of intermediates() that it is called in (not if
    it is to outlive that)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quernstone-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    (_outliving if outlive else _written)[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quernstone_path = path
    return out


def release(table_: DataFrame) -> None:
    """Delete what materialize() wrote, once all that was read from it is written itself."""
    path = table_._quernstone_path
    for held in (_written, _outliving):
        if path in held:
            _delete(path, held.pop(path))


@contextmanager
def intermediates() -> Iterator[None]:
    """Whatever materialize() writes inside is deleted at the end: for drivers that live long.
    What is read from it has to be written before."""
    before = set(_written)
    try:
        yield
    finally:
        for path in [p for p in _written if p not in before]:
            _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _remove_written() -> None:
    for path, spark in (_written | _outliving).items():
        with suppress(Exception):  # the session may be gone at exit; the folder then stays
            _delete(path, spark)


def bounded_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the Arrow batches that Python functions get by bytes: ten thousand long texts
    at once, which is what the default allows, would not fit beside the JVM's heap."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", "67108864", "64m"):
        spark.conf.set(key, size)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row. A plain column that a lambda uses
    may be inlined by the optimizer and computed again for each element."""
    return F.transform(F.array(value), body).getItem(0)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _UPPER.lower())


def hex_digits(rows: int, per_group: int = 1000, most: int = 4) -> int:
    """Hex digits of a uniform hash that part `rows` rows into groups of about
    `per_group` (more only beyond 16 ** most groups)."""
    k = 0
    while k < most and rows > per_group * 16**k:
        k += 1
    return k


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]
