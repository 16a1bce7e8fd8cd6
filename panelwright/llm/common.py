"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than ASCII white space (0x20, 0x09-0x0D), taken
from UTF-8; ``bytes.split()`` without arguments has just that rule.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows, and bytes of text, that a function over texts is given at once; a longer text comes alone.
BATCH_ROWS, BATCH_BYTES = 400, 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where it is unset and all runs in one process (tests) a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not held.isDefined() and spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="panelwright-")
        if not held.isDefined():
            spark.sparkContext.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that neither lineage nor a lost executor costs a rerun."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read again: compressed, and columns can be left out."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{fresh('rows')}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of at most ``rows`` rows and, but for longer single texts, ``size`` bytes of ``column``.

    Spark bounds its own batches by bytes (64 MB), so that no session setting has to be changed.
    """
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield batch.slice(at, to - at)
            at = to


def fresh(prefix: str) -> str:
    """A name that no other run uses."""
    return f"{prefix}_{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for an operator's own working columns, one for each given, that ``df`` does not have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_on_hot_key(rows: DataFrame, keyed: DataFrame, key: str, weight: str, total: int, share: int = 1000) -> DataFrame:
    """``rows`` joined to ``keyed`` (one row a key; ``weight``: how many rows have it) without a hot task.

    Keys that hold a ``share``-th of all ``total`` rows or more, of which there are at most
    ``share``, are broadcast; the other keys are joined by shuffle. ``weight`` is left out.
    """
    keyed = keyed.withColumn("_hot", F.col(weight) * share >= total).drop(weight)
    hot = F.broadcast(keyed.where("_hot").drop("_hot"))
    rest = rows.join(F.broadcast(keyed.where("_hot").select(key)), key, "left_anti").join(keyed.where("not _hot").drop("_hot"), key)
    return rows.join(hot, key).unionByName(rest)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names an operator's outputs take (case-insensitive)."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def text_or_empty(column: str = "text"):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def schema_of(df: DataFrame, more: str = "") -> StructType:
    """The schema of ``df`` with further columns given as DDL."""
    fields = list(df.schema.fields)
    return StructType(fields + (list(StructType.fromDDL(more).fields) if more else []))


def utf8(column: pa.Array) -> list[bytes]:
    """A string or binary column as a list of bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_texts(df: DataFrame, make, schema: StructType | str, column: str = "text") -> DataFrame:
    """mapInArrow with ``make()`` called once per task to build the batch function; ``column`` holds the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in slices(batches, column):
            f = f or make()
            yield f(batch)

    return df.mapInArrow(run, schema)


def mix(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    """Order-sensitive 64-bit mixing of two unsigned arrays (multiply-xorshift rounds)."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + np.asarray(b, dtype=np.uint64)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(29)
    return x


def strings_hash(values: list[bytes], seed: int) -> np.ndarray:
    """XXH64 of each byte string as unsigned 64-bit numbers."""
    import xxhash

    h = xxhash.xxh64_intdigest
    return np.fromiter((h(v, seed) for v in values), dtype=np.uint64, count=len(values))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
