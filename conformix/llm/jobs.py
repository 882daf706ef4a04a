"""What the operators share on Spark's side: sizes, shared files, lineage cuts."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import mix

#: Largest hash filter over ids: 2^27 bits.
FILTER_BITS = 27
#: Rows and bytes of a batch between the JVM and Python, where the session doesn't set them.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4096", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Paths of saved tables by application.
_kept: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir.

    Only on one machine (a local master, as in tests) is a folder made and set where
    the setting is absent; elsewhere executors wouldn't share it, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", "") or ""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="conformix-"))
    folder = folder or context._jsc.sc().getCheckpointDir().get()
    return re.sub("^file:/+", "file:///", folder.rstrip("/"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, reliably stored in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as a Parquet table in the shared folder and read again.

    discard() deletes such a table when nothing reads it any more, clear() all of a session.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    _kept.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def stored(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The rows that make() gives, stored; the tables that were saved on the way are deleted."""
    kept = _kept.setdefault(spark.sparkContext.applicationId, set())
    before = set(kept)
    out = saved(make(), name)
    for path in kept - before - {out._saved_at}:
        _delete(spark, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that saved() wrote. What was computed from them must be stored already."""
    for df in tables:
        _delete(df.sparkSession, df._saved_at)


def clear(spark: SparkSession) -> None:
    """Deletes all tables that this application's operators saved and didn't discard; call it when their results are stored."""
    for path in sorted(_kept.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _kept.get(spark.sparkContext.applicationId, set()).discard(path)


def buckets(spark: SparkSession) -> int:
    """Number of hash buckets for blobs: as many as the session's shuffle partitions."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def small_batches(spark: SparkSession) -> None:
    """Sets what the session leaves unset of BATCHES: Spark's own sizes suit numbers, but not texts."""
    known = spark.conf.getAll
    for name, value in BATCHES.items():
        if name not in known:
            spark.conf.set(name, value)


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run):
    """The same function of batches; afterwards the worker, which waits for other tasks, gives its free memory back."""

    def tidied(batches):
        yield from run(batches)
        _release()

    return tidied


def tidy_group(run):
    """As tidy, for a function of a key and a table."""

    def tidied(key, table):
        out = run(key, table)
        _release()
        return out

    return tidied


def tidy_cogroup(run):
    """As tidy, for a function of a key and two tables."""

    def tidied(key, left, right):
        out = run(key, left, right)
        _release()
        return out

    return tidied


class NotEnoughLabels(ValueError):
    """There is nothing to learn from: fewer than two different labels."""


def numbered(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """The same columns as c0, c1, ... by position, and which of them the wanted ones are.

    Names can then neither clash nor be ambiguous; toDF(*names) gives them back.
    """
    small_batches(df.sparkSession)
    names = df.columns
    for name in wanted:
        if name not in names:
            raise ValueError(f"no column {name!r} among {names}")
    return df.toDF(*[f"c{i}" for i in range(len(names))]), [f"c{names.index(name)}" for name in wanted]


def picked(df: DataFrame, **wanted: str) -> DataFrame:
    """The wanted columns under new names, found by exact name.

    Other columns can have any names, even ones that differ in case alone or
    repeat: the first exact match counts.
    """
    plain, found = numbered(df, *wanted.values())
    return plain.select(*[plain[c].alias(new) for new, c in zip(wanted, found)])


def add_longs(parts: list[bytes]) -> bytes:
    """Sum of packed 64-bit vectors."""
    total = np.frombuffer(parts[0], np.int64).copy()
    for x in parts[1:]:
        total += np.frombuffer(x, np.int64)
    return total.tobytes()


def _any(parts: list[bytes]) -> bytes:
    total = np.frombuffer(parts[0], np.uint8).copy()
    for x in parts[1:]:
        total |= np.frombuffer(x, np.uint8)
    return total.tobytes()


def folded(vectors: DataFrame, add, width: int = 64) -> DataFrame:
    """Packed vectors (slice, data) combined by slice, in a tree: one from each task is too much for one group."""

    def run(key, table):
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([add([x.as_py() for x in table.column("data")])], pa.binary())})

    parts = vectors.select("slice", "data", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(width)).alias("part"))
    return parts.groupBy("slice", "part").applyInArrow(run, "slice int, data binary").groupBy("slice").applyInArrow(run, "slice int, data binary")


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _mark(bits: int):
    def run(batches):
        marks = np.zeros(1 << bits, bool)
        for batch in batches:
            marks[_slots(batch.column(0).to_numpy(zero_copy_only=False), bits)] = True
        if marks.any():
            packed = np.split(np.packbits(marks), 16)
            yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([x.tobytes() for x in packed], pa.binary())], ["slice", "data"])

    return run


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A hash filter over a column of n longs, of 64 to 128 bits each up to 2^FILTER_BITS.

    passes() is true for each id of the column and for few others.
    """
    size = min(max(16, (64 * n).bit_length()), FILTER_BITS)
    bits = np.zeros((16, (1 << size) // 128), np.uint8)
    for r in folded(ids.mapInArrow(_mark(size), "slice int, data binary"), _any).collect():
        bits[r["slice"]] = np.frombuffer(r["data"], np.uint8)
    return bits.ravel()


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _slots(ids, (8 * len(bits)).bit_length() - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _passing(bits: np.ndarray):
    def run(batches):
        for batch in batches:
            some = passes(bits, batch.column(0).to_numpy(zero_copy_only=False))
            if some.any():
                yield batch.filter(pa.array(some))

    return run


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df (whose column id comes first) that may have one of the ids: all that have, and few others.

    Up to 2^FILTER_BITS / 8 ids, a filter of 16 MiB at most goes to the tasks and
    nothing is shuffled; more are joined.
    """
    n = ids.count()
    if 8 * n > 1 << FILTER_BITS:
        return df.join(ids.select("id").distinct(), "id", "left_semi").select(*df.columns)
    return df.mapInArrow(_passing(id_filter(ids, n)), df.schema)
