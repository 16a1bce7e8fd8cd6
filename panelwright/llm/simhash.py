"""SimHash near-duplicates found by covering locality-sensitive hashing.

A 64-bit fingerprint holds, bit by bit, the majority over the XXH64 hashes of a text's word
shingles. Two texts are linked if their fingerprints differ in at most ``radius`` bits.

Candidate search is covering LSH (Pagh, 2016): every bit position gets a random vector of
radius + 1 bits, and table v (any non-zero vector) keeps the positions whose vector has an odd
inner product with v. The at most ``radius`` positions where two fingerprints differ span at
most ``radius`` dimensions, so some v is orthogonal to all of them; in that table the pair has
equal keys. There are no false negatives and 2^(radius+1) - 1 tables.

Equal fingerprints are one node from the start, so groups of exact copies cost one row. Inside
a bucket the nodes are joined to a forest by blocked comparison; at most one edge a node
leaves a bucket, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, join_on_hot_key, map_texts, read, schema_of, stored, unused, utf8, without
from .components import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of one text; 0 if it has no word."""
    import xxhash

    text = text.translate(LOWER)
    words = text.split()
    if not words:
        return 0
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
        starts = np.concatenate(([0], ends[:-shingle])).tolist()
        grams = [line[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(grams), 65536):
        part = grams[at : at + 65536]
        h = np.fromiter((digest(g, 42) for g in part), dtype="<u8", count=len(part))
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(grams), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``docs`` (any columns; ``text``) with column ``fp``: the fingerprint as a signed long. Null text counts as empty."""
    base = without(docs, "fp")

    def make():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.array([fingerprint(t, shingle) for t in utf8(batch.column("text"))], dtype=np.uint64)
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], names=[*batch.schema.names, "fp"])

        return f

    return map_texts(base, make, schema_of(base, "fp long"))


def covering_masks(radius: int = 4, bits: int = 64, seed: int = 7) -> list[int]:
    """The 2^(radius+1) - 1 masks; any ``radius`` positions are all clear in at least one."""
    rng = np.random.default_rng(seed)
    size = 1 << (radius + 1)
    # every vector is dealt equally often, so masks have near equal weights
    phi = rng.permutation(np.resize(np.arange(size), bits))
    odd = lambda x: bin(x).count("1") & 1
    return [sum(1 << i for i in range(bits) if odd(int(phi[i]) & v)) for v in range(1, size)]


def _distance_forest(fps: np.ndarray, radius: int, block: int = 1024) -> list[tuple[int, int]]:
    """Edges (indices) of a spanning forest of the graph 'at most radius bits apart'.

    Rows are sorted by their distance from the bitwise majority: rows whose distances differ by
    more than the radius cannot be linked, so each block meets only a band of the others.
    Rows that already share a tree are not linked again.
    """
    n = len(fps)
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = int(parent[i])
        return i

    if n > 64:
        spread = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        centre = np.packbits(2 * spread.sum(axis=0, dtype=np.int64) > n, bitorder="little").view("<u8")[0]
        far = np.bitwise_count(fps ^ centre).astype(np.int64)
    else:
        far = np.zeros(n, dtype=np.int64)
    order = np.argsort(far, kind="stable")
    fps, far = fps[order], far[order]
    edges: list[tuple[int, int]] = []
    for a in range(0, n, block):
        top = min(a + block, n)
        last = int(np.searchsorted(far, far[top - 1] + radius, side="right"))
        for b in range(a, last, block):
            end = min(b + block, last)
            close = np.bitwise_count(fps[a:top, None] ^ fps[None, b:end]) <= radius
            i, j = np.nonzero(close)
            keep = i + a < j + b
            i, j = i[keep] + a, j[keep] + b
            while len(i):  # one pair of each two trees is enough; then look again
                roots = np.array([find(x) for x in range(n)]) if len(i) > n else None
                ri = roots[i] if roots is not None else np.array([find(x) for x in i.tolist()])
                rj = roots[j] if roots is not None else np.array([find(x) for x in j.tolist()])
                left = ri != rj
                i, j, ri, rj = i[left], j[left], ri[left], rj[left]
                if not len(i):
                    break
                low, high = np.minimum(ri, rj), np.maximum(ri, rj)
                _, first = np.unique(high, return_index=True)
                for k in first.tolist():
                    x, y = find(int(low[k])), find(int(high[k]))
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        edges.append((int(i[k]), int(j[k])))
    return [(int(order[x]), int(order[y])) for x, y in edges]


def _bucket_edges(radius: int):
    """mapInArrow function over rows sorted by (tab, key): the forests of all buckets as edges a, b."""

    def forests(tab, key, fp):
        edge = np.flatnonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1])) + 1
        lo, hi = np.concatenate(([0], edge)), np.concatenate((edge, [len(tab)]))
        found = []
        two = lo[(hi - lo) == 2]
        if len(two):
            x, y = fp[two], fp[two + 1]
            ok = np.bitwise_count(x ^ y) <= radius
            found.append((x[ok], y[ok]))
        for a, b in zip(lo[(hi - lo) > 2].tolist(), hi[(hi - lo) > 2].tolist(), strict=True):
            own = fp[a:b]
            pairs = _distance_forest(own, radius)
            if pairs:
                i, j = np.array(pairs).T
                found.append((own[i], own[j]))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the last bucket, joined once when it is complete
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if not len(cols[0]):
                continue
            edge = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1
            goes_on = not held or (held[-1][0][-1] == cols[0][0] and held[-1][1][-1] == cols[1][0])
            if goes_on and not len(edge):
                held.append(cols)
                continue
            cutoff = int(edge[-1]) if len(edge) else 0
            done = [*held, [x[:cutoff] for x in cols]] if goes_on or cutoff else held
            yield from emit(forests(*whole(done)))
            held = [[x[cutoff:] for x in cols]]
        if held:
            yield from emit(forests(*whole(held)))

    def whole(parts):
        tab, key, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        return tab, key, fp.view(np.uint64)

    def emit(found):
        if found:
            a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return run


def near_links(nodes: DataFrame, radius: int = 4) -> DataFrame:
    """Forest edges a, b among the distinct fingerprints ``fp`` of ``nodes``, bucket by bucket."""
    masks = covering_masks(radius)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = F.array(*[F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    rows = nodes.select("fp", F.explode(tables).alias("t")).select("t.tab", "t.key", "fp")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "tab", "key").sortWithinPartitions("tab", "key")
    return dealt.mapInArrow(_bucket_edges(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` with ``fp`` and ``component_id``, the smallest ``doc_id`` that links reach.

    Every input row returns once, with all its columns but the text. Texts without words have
    fingerprint zero and are linked like any other. A row whose doc_id is null takes part and
    has the component of its group (null only if no member has an id). Repeated rows stay.
    Inputs that hold ``fp``, ``component_id`` lose those columns to the outputs. Runs jobs when called.
    """
    return _grouped(docs, shingle, radius)


def _grouped(docs: DataFrame, shingle: int, radius: int, *root: str) -> DataFrame:
    """``near_duplicates`` with the column ``root``, if named: a fingerprint that names the group whatever its ids."""
    marked = cut(with_fingerprints(without(docs, "fp", "component_id"), shingle).drop("text"))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_rows")))
    n, rows = nodes.agg(F.count(F.lit(1)), F.sum("_rows")).first()
    found = connected_components(near_links(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    rooted = cut(nodes.join(found, "fp", "left").select("fp", "_least", "_rows", F.coalesce("root", "fp").alias("_root")))
    lowest = rooted.groupBy("_root").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_nodes"))
    named = join_on_hot_key(rooted, cut(lowest), "_root", "_nodes", n)
    named = cut(named.select("fp", "component_id", "_rows", *[F.col("_root").alias(x) for x in root]))
    return join_on_hot_key(marked, named, "fp", "_rows", rows or 0)


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """``docs`` less all but one row of every near-duplicate group: the one with the smallest ``doc_id``.

    Of repeated rows with that id one stays; a row whose id is null stays only if its group has no ids.
    The survivors are settled on ids and fingerprints alone, then picked from ``docs`` by a join.
    """
    row, root = unused(docs, "row", "root")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    found = _grouped(rows.select("doc_id", "text", row), shingle, radius, root)
    own = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # equal ids, or null ids, of one group are told apart by row number
    kept = own.groupBy(root).agg(F.min(row).alias(row)).select(row)
    return rows.join(kept, row, "left_semi").drop(row)


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
