"""Byte-balanced shards by histogram sort.

Rows are ordered by a key: 60 bits of the text's MD5, then the id, so equal texts are
neighbours. Shard borders are found without sorting (histogram sort): the driver proposes
probe keys, every partition counts the bytes and rows below them, the sums come back, and
each border's bracket shrinks to the probes around its target. When a bracket holds few rows
these are fetched; when it is one hash value, a group of copies, probing goes on by id. Then
one exchange puts every row in its place.

Borders are exact: the row before whose key c of all T bytes lie has shard floor(shards * c / T).
Places in a shard are numbered in parts of bounded row counts, whose borders are found alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import cut, read, schema_of, unused, without

#: Probes a border and round; rows of a bracket that are fetched; rows sorted in one task, about.
PROBES, FETCHED, TASK_ROWS = 128, 128, 250_000
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def sized(docs: DataFrame, hash_: str = "_hash", id_: str = "_id") -> DataFrame:
    """``docs`` without its text, with ``size`` (bytes and 8), ``text_crc32`` and the sort key in two columns.

    Ids that are not whole numbers take their place by hash.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = without(docs, "size", "text_crc32", hash_, id_)
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    key = F.col("doc_id").cast("long") if whole else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    return base.select(
        *[c for c in base.columns if c != "text"],
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias(hash_),
        F.coalesce(key, F.lit(LOW)).alias(id_),
    )


def _histogram(rows: DataFrame, column: str, probes: list[int], within: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and rows between sorted probes: one pass that sends a row a slot and task, of which the sums come back."""
    held = np.array(sorted(probes), dtype=np.int64)
    if within is not None:
        rows = rows.where(F.col("_hash") == within[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, count = np.zeros(len(held) + 1, dtype=np.int64), np.zeros(len(held) + 1, dtype=np.int64)
        for batch in batches:
            slot = np.searchsorted(held, batch.column(0).to_numpy(), side="right")
            np.add.at(size, slot, batch.column(1).to_numpy())
            np.add.at(count, slot, 1)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(size[used]), pa.array(count[used])], names=["slot", "bytes", "n"])

    sums = rows.select(column, "size").mapInArrow(run, "slot long, bytes long, n long").groupBy("slot").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).collect()
    size, count = np.zeros(len(held) + 1, dtype=object), np.zeros(len(held) + 1, dtype=np.int64)
    for r in sums:
        size[r["slot"]], count[r["slot"]] = r["bytes"], r["n"]
    return size, count


def _narrow(rows: DataFrame, column: str, borders: dict[int, list], within: list[int] | None = None) -> None:
    """Shrink brackets [low, high, bytes below low, rows inside] until each has few rows or one key."""
    while wide := {i: b for i, b in borders.items() if b[3] > FETCHED and b[1] - b[0] > 1}:
        probes = sorted({b[0] + (b[1] - b[0]) * k // (PROBES + 1) for b in wide.values() for k in range(PROBES + 2)})
        size, count = _histogram(rows, column, probes, within)
        below = np.concatenate(([0], np.cumsum(size)))  # below[j + 1]: bytes under probe j
        start = np.array(probes)
        base = {}
        for i, b in wide.items():
            # bytes under the bracket are known; sums are taken from there
            first = int(np.searchsorted(start, b[0]))
            known = b[2] - below[first + 1]
            inside = [j for j in range(first, int(np.searchsorted(start, b[1])) + 1)]
            j = max((j for j in inside if below[j + 1] + known < b[4]), default=first)
            j = min(j, inside[-2])
            base[i] = [int(start[j]), int(start[j + 1]), below[j + 1] + known, int(count[j + 1]), b[4]]
        borders.update(base)


def splitters(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """The keys that start parts 1 to ``parts`` - 1: the least key with i / parts of all bytes below it.

    ``rows``: ``_hash``, ``_id``, ``size``. No rows, no keys.
    """
    whole = rows.agg(F.sum("size"), F.count("*")).first()
    total, n = whole[0] or 0, whole[1]
    if not n:
        return []
    # a border lies at the first key that has the target below it; the last key that has less is looked for
    targets = {i: -(-i * total // parts) for i in range(1, parts)}
    borders = {i: [0, 1 << 60, 0, n, t] for i, t in targets.items()}
    _narrow(rows, "_hash", borders)
    hot = {i: b for i, b in borders.items() if b[3] > FETCHED}
    found: dict[int, tuple[int, int]] = {}
    few = {i: b for i, b in borders.items() if b[3] <= FETCHED}
    for value in sorted({b[0] for b in hot.values()}):
        own = {i: [LOW, HIGH, b[2], b[3], b[4]] for i, b in hot.items() if b[0] == value}
        _narrow(rows, "_id", own, [value])
        found |= _fetch(rows.where(F.col("_hash") == value), "_id", own)
    found |= _fetch(rows, "_hash", few)
    return [found[i] for i in range(1, parts)]


def _fetch(rows: DataFrame, column: str, borders: dict[int, list]) -> dict[int, tuple[int, int]]:
    """Walk the few keys of each bracket to the first with the target below it."""
    if not borders:
        return {}
    spans = sorted({(b[0], b[1]) for b in borders.values()})
    lows, highs = np.array([s[0] for s in spans], dtype=np.int64), np.array([s[1] for s in spans], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(column).to_numpy()
            at = np.searchsorted(lows, v, side="right") - 1
            yield batch.filter(pa.array((at >= 0) & (v < highs[np.maximum(at, 0)])))

    # repeated keys are summed where they lie, so a bracket of one key is one row
    near = rows.select("_hash", "_id", "size").mapInArrow(run, "_hash long, _id long, size long").groupBy("_hash", "_id").agg(F.sum("size").alias("size"))
    keys = sorted((r["_hash"], r["_id"], r["size"]) for r in near.collect())
    side = 0 if column == "_hash" else 1
    out = {}
    for i, (low, high, below, _, target) in borders.items():
        own = [k for k in keys if low <= k[side] < high]
        for h, d, size in own:
            if below >= target:
                out[i] = (h, d)
                break
            below += size
        else:  # the next key, whatever it is, starts the part
            h, d = (own[-1][0], own[-1][1]) if own else (low, LOW) if side == 0 else (0, low)
            out[i] = (h, d + 1) if d < HIGH else (h + 1, LOW)
    return out


def _after(keys: list[tuple[int, int]]):
    """How many of the sorted keys are at or before each (hash, id)."""
    hashes, ids = np.array([k[0] for k in keys], dtype=np.int64), np.array([k[1] for k in keys], dtype=np.int64)

    def f(h: np.ndarray, d: np.ndarray) -> np.ndarray:
        part, upto = np.searchsorted(hashes, h, side="left"), np.searchsorted(hashes, h, side="right")
        for value in np.unique(h[upto > part]).tolist():
            own = h == value
            a, b = np.searchsorted(hashes, value, side="left"), np.searchsorted(hashes, value, side="right")
            part[own] = a + np.searchsorted(ids[a:b], d[own], side="right")
        return part

    return f


def balanced_shards(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``docs`` without its text, with ``size``, ``text_crc32``, ``shard`` and ``slot``, its place in the shard.

    Sizes are near equal: they differ by less than twice the largest row. Null texts have no
    bytes, and null ids come first among equal texts. Rows with equal text and id are not parted,
    and their order is open. Ids may be of any type; those that aren't whole numbers are ordered
    by hash. Empty input gives an empty result. Runs jobs when called.
    """
    base = without(docs, "size", "text_crc32", "shard", "slot")
    hash_, id_, part = unused(base, "hash", "id", "part")
    rows = cut(sized(base, hash_, id_))
    keys = rows.select(F.col(hash_).alias("_hash"), F.col(id_).alias("_id"), "size")
    borders = splitters(keys, shards)
    # a shard may hold many small rows: it is numbered in parts of equal row counts
    n = keys.count()
    parts = splitters(keys.withColumn("size", F.lit(1).cast("long")), max(1, -(-n // TASK_ROWS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard_of, part_of = _after(borders), _after(parts)
        for batch in batches:
            h, d = batch.column(hash_).to_numpy(), batch.column(id_).to_numpy()
            more = [pa.array(f(h, d).astype(np.int32)) for f in (shard_of, part_of)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "shard", part])

    placed = rows.mapInArrow(run, schema_of(rows, f"shard int, {part} int"))
    # a row a part: as many as shards and parts of TASK_ROWS rows, together
    counts = sorted((r["shard"], r[part], r["count"]) for r in placed.groupBy("shard", part).count().collect())
    starts, at = [], 0
    for k, (own, p, c) in enumerate(counts):
        at = 0 if k and own != counts[k - 1][0] else at
        starts.append((own, p, at))
        at += c
    (start,) = unused(placed, "start")
    offsets = F.broadcast(docs.sparkSession.createDataFrame(starts, f"shard int, {part} int, {start} long"))
    place = F.row_number().over(Window.partitionBy("shard", part).orderBy(hash_, id_))
    return placed.withColumn("slot", place).join(offsets, ["shard", part]).withColumn("slot", F.col("slot") - 1 + F.col(start)).drop(part, hash_, id_, start)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, bytes balanced over 24 shards."""
    out = balanced_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
