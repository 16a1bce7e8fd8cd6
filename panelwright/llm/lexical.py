"""Ranked lexical search by sort-based accumulation.

The items of a stated query set are searched against all documents, a block of items at a time.
One pass counts documents, terms and, for the block's own terms, the documents that hold them.
A second pass scores: in a task, the (document, term) matches of a stretch of documents are
concatenated with the items of each term into arrays of item, document and impact; item and
document are packed into one key, the keys are radix sorted, and ``reduceat`` sums the impacts
of equal keys. A heap an item keeps the best of a task.

All entries of one document are made in one task, so no entry is ever shuffled. What tasks keep is
range-partitioned by item, score and id, so that no task takes all candidates of an item; each
range keeps its best again by heap, and what is left of an item is ranked.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, slices, utf8
from .decontaminate import _blocks, words_of

#: Bytes of items searched in one pass; entries sorted at once; bytes of a text that are split into words at once.
ITEMS_BYTES, ENTRIES, SPLIT_BYTES = 4 << 20, 1 << 21, 4 << 20
#: Rows that stand for documents and terms among the counted terms.
_DOCUMENTS, _TERMS = -1, -2


class Queries:
    """A block of items, inverted: per term the items that hold it and how often."""

    def __init__(self, items: list[tuple[object, bytes]]):
        self.ids = [key for key, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        term, item, times = [], [], []
        for k, (_, text) in enumerate(items):
            for word, n in Counter(words_of(text)).items():
                term.append(self.vocabulary.setdefault(word, len(self.vocabulary)))
                item.append(k)
                times.append(n)
        order = np.argsort(np.array(term, dtype=np.int64), kind="stable")
        self.item, self.times = (np.array(v, dtype=np.int64)[order] for v in (item, times))
        self.held = np.bincount(np.array(term, dtype=np.int64), minlength=len(self.vocabulary)).astype(np.int64)
        self.begin = np.cumsum(self.held) - self.held
        self.weight = np.zeros(len(self.vocabulary), dtype=np.int64)
        self.documents = self.terms = 0

    def weigh(self, counts: dict[int, int]) -> None:
        """Take the collection's counts: documents, terms, and documents a term."""
        self.documents, self.terms = counts.get(_DOCUMENTS, 0), counts.get(_TERMS, 0)
        for t in range(len(self.vocabulary)):
            self.weight[t] = math.floor(1000 * math.log((2 * self.documents + 2) / (2 * counts.get(t, 0) + 1)))

    def matches(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """(document, term, occurrences) in order of document, of the block's terms, and the terms of each document in all."""
        get, parts, sizes = self.vocabulary.get, [], []
        for d, text in enumerate(texts):
            n = 0
            for words in split(text):
                n += len(words)
                own = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words))
                parts.append(own[own >= 0] + d * len(self.vocabulary))
            sizes.append(n)
        keys, times = np.unique(np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64), return_counts=True)
        doc, term = np.divmod(keys, max(1, len(self.vocabulary)))
        return doc, term, times.astype(np.int64), sizes


def split(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, those of very long ones in stretches."""
    at = 0
    while len(text) - at > SPLIT_BYTES:
        piece = text[at : at + SPLIT_BYTES]
        # a stretch ends at its last ASCII blank; one without any is taken with what follows
        end = max(piece.rfind(b" "), piece.rfind(b"\n"))
        if end < 0:
            ends = [e for e in (text.find(b" ", at + SPLIT_BYTES), text.find(b"\n", at + SPLIT_BYTES)) if e >= 0]
            end = (min(ends) if ends else len(text)) - at
        yield words_of(text[at : at + end])
        at += end + 1
    yield words_of(text[at:])


def radix_order(keys: np.ndarray, top: int) -> np.ndarray:
    """The order of whole numbers up to ``top``, by one counting sort for each of their 16-bit digits, the lowest first."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, max(int(top).bit_length(), 1), 16):
        order = order[np.argsort(((keys[order] >> shift) & 0xFFFF).astype(np.uint16), kind="stable")]
    return order


def scores(own: Queries, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item, document, score) of all pairs with a score above 0, in stretches of documents."""
    doc, term, times, sizes = own.matches(texts)
    if not len(doc):
        return
    # whole numbers of any size: documents times terms may pass 64 bits
    dull = np.array([75 + (25 * n * own.documents) // own.terms for n in sizes], dtype=np.int64)
    impact = own.weight[term] * ((1_000_000_000 * times) // (1000 * times + 12 * dull[doc]))
    entries = own.held[term]
    most = max(1, (1 << 16) // len(own.ids))  # documents whose keys fit one digit
    upto = np.cumsum(entries)
    at = 0
    while at < len(doc):
        first = int(doc[at])
        to = int(np.searchsorted(doc, first + most))
        limit = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + ENTRIES, side="right"))
        if limit < to:  # whole documents only, one at least
            to = max(int(np.searchsorted(doc, doc[limit])), int(np.searchsorted(doc, first, side="right")))
        n, width = entries[at:to], int(doc[to - 1]) - first + 1
        which = np.repeat(np.arange(at, to), n)
        place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(own.begin[term[at:to]], n)
        key = own.item[place] * width + (doc[which] - first)
        order = radix_order(key, len(own.ids) * width - 1)
        key, value = key[order], (impact[which] * own.times[place])[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total, key = np.add.reduceat(value, start), key[start]
        some = total > 0
        item, d = np.divmod(key[some], width)
        yield item, d + first, total[some]
        at = to


class Best:
    """The best ``k`` (score, id) of each item: higher scores first, then lesser ids, null ids last."""

    def __init__(self, items: int, k: int):
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least = np.zeros(items, dtype=np.int64)
        self.k = k

    def put(self, item: np.ndarray, ids: list[int | None], score: np.ndarray) -> None:
        """Offer rows; ``ids`` are those of the rows."""
        near = np.flatnonzero(score >= self.least[item])
        for i, s, row in zip(item[near].tolist(), score[near].tolist(), near.tolist(), strict=True):
            key, heap = ids[row], self.heaps[i]
            own = (s, -key if key is not None else -(1 << 64))
            if len(heap) < self.k:
                heapq.heappush(heap, own)
            elif own > heap[0]:
                heapq.heapreplace(heap, own)
            if len(heap) == self.k:
                self.least[i] = heap[0][0]

    def rows(self) -> tuple[list[int], list[int | None], list[int]]:
        """Items, ids and scores kept."""
        kept = [(i, None if key == -(1 << 64) else -key, s) for i, heap in enumerate(self.heaps) for s, key in heap]
        return [r[0] for r in kept], [r[1] for r in kept], [r[2] for r in kept]


def _counted(docs: DataFrame, queries) -> dict[int, int]:
    """Documents with a term, all terms, and the documents of each of the block's terms: sums of what tasks count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Queries = queries.value
        held, n, terms = np.zeros(len(own.vocabulary), dtype=np.int64), 0, 0
        for batch in slices(batches, "text"):
            _, term, _, sizes = own.matches(utf8(batch.column("text")))
            held += np.bincount(term, minlength=len(held))
            n, terms = n + sum(s > 0 for s in sizes), terms + sum(sizes)
        used = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array([_DOCUMENTS, _TERMS, *used.tolist()], type=pa.int64()), pa.array([n, terms, *held[used].tolist()], type=pa.int64())], names=["term", "n"])

    sums = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"]: r["n"] for r in sums.collect()}


def _ranked_block(docs: DataFrame, items: list[tuple[object, bytes]], kind: str, k: int) -> DataFrame:
    """The best of one block of items."""
    context, own = docs.sparkSession.sparkContext, Queries(items)
    own.weigh(_counted(docs, context.broadcast(own)))
    queries = context.broadcast(own)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Queries = queries.value
        best = Best(len(own.ids), k)
        for batch in slices(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            for item, d, score in scores(own, utf8(batch.column("text"))):
                best.put(item, _Rows(ids, d), score)
        yield _batch(best)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.value.ids), k)
        for batch in batches:
            best.put(batch.column("item").to_numpy().astype(np.int64), batch.column("doc_id").to_pylist(), batch.column("score").to_numpy())
        yield _batch(best)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = queries.value.ids
        for batch in batches:
            keys = pa.array([ids[i] for i in batch.column("item").to_pylist()], type=batch.schema.field("item_id").type)
            yield batch.set_column(batch.schema.get_field_index("item_id"), "item_id", keys)

    shape = "item int, doc_id long, score long"
    found = cut(docs.select("doc_id", "text").mapInArrow(search, shape))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    ranges = found.repartitionByRange("item", *order).mapInArrow(select, shape)
    ranked = ranges.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
    ranked = ranked.select(F.lit(None).cast(kind).alias("item_id"), "item", "rank", "doc_id", "score")
    return ranked.mapInArrow(named, ranked.schema).drop("item")


class _Rows:
    """The ids of rows, looked up only where they are asked for."""

    def __init__(self, ids: list, rows: np.ndarray):
        self.ids, self.at = ids, rows

    def __getitem__(self, row: int):
        return self.ids[self.at[row]]


def _batch(best: Best) -> pa.RecordBatch:
    item, ids, score = best.rows()
    return pa.RecordBatch.from_arrays([pa.array(item, type=pa.int32()), pa.array(ids, type=pa.int64()), pa.array(score, type=pa.int64())], names=["item", "doc_id", "score"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` best documents of each item: item_id, rank (from 1), doc_id, score; documents without a score are left out.

    ``docs``: ``doc_id`` (whole numbers), ``text``; ``items``: ``item_id``, ``text``, the stated query
    set; further columns are left out. Terms are runs of ASCII letters and digits and of any
    characters beyond ASCII, A-Z lower-cased, taken from whole texts; a null or empty text has none.
    Weights and scores are as the module's contract gives them. Equal scores are ordered by id, null
    ids last; every row of ``docs`` and of ``items`` counts for itself, repeated ones too. An item
    without a term, an empty table of items or of documents gives no rows.

    Items are taken in blocks of ``ITEMS_BYTES`` of text, each of which costs two passes over the
    documents. A block's terms and their counts are all that the driver holds. Runs jobs when called.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind, out = items.schema["item_id"].dataType.simpleString(), None
    for block in _blocks(items, ITEMS_BYTES):
        part = _ranked_block(docs, block, kind, k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out


def op11_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 20)


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), c AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d
), m AS (
  SELECT r, doc_id, 75 + (25 * len(w) * n_docs) // n_terms AS m FROM d, c WHERE len(w) > 0
), t AS (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL
), f AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM (SELECT term, count(*) AS df FROM t GROUP BY term), c
), q AS (
  SELECT i, item_id, term, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS term FROM i) GROUP BY ALL
), s AS (
  SELECT i, item_id, r, doc_id, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN m USING (r) GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 20
"""
