"""Benchmark decontamination by an FM-index over every shard of the training text.

A shard is a few megabytes of documents, laid end to end as word numbers. Its suffix array is
built by prefix doubling, its Burrows-Wheeler transform is kept in a wavelet matrix, and every
``SAMPLE``-th text position keeps its suffix position. All test phrases are searched at once,
backward, one rank step a word; the rows found are walked to sampled positions by LF steps,
and the spans of the occurrences are merged document by document.

Words that no phrase holds can't be part of an occurrence. Each is a symbol of its own, above
the test vocabulary, so it ends ties in the suffix order at once and never needs a rank: a
position after such a word is sampled as well, and walks stop there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, schema_of, slices, utf8, without

#: Words are runs of ASCII letters and digits and of any bytes beyond ASCII, A-Z lower-cased.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: UTF-8 bytes of a shard; bytes of test items that are held and searched at once; sampling distance; windows searched at once; item names of a batch.
SHARD_BYTES, ITEMS_BYTES, SAMPLE, WINDOWS, LISTED = 4 << 20, 64 << 20, 16, 1 << 16, 1 << 20


def words_of(text: bytes) -> list[bytes]:
    """The folded words of a text."""
    return text.translate(_FOLD).split()


def suffix_order(seq: np.ndarray, plain: int) -> np.ndarray:
    """Suffix array of ``seq``; symbols of ``plain`` and above occur once each.

    Prefix doubling that sorts again only the suffixes whose rank is still shared.
    """
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    sorted_ = seq[order]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    size = np.bincount(start, minlength=n)
    tied = np.flatnonzero(size[start] > 1)  # rows, in order
    k = 1
    while len(tied):
        pos = order[tied]
        after = np.where(pos + k < n, rank[np.minimum(pos + k, n - 1)] + 1, 0)
        key = rank[pos] * np.int64(n + 2) + after
        by = np.argsort(key, kind="stable")
        pos, key = pos[by], key[by]
        order[tied] = pos
        new = np.concatenate(([True], key[1:] != key[:-1]))
        start = np.maximum.accumulate(np.where(new, tied, 0))
        rank[pos] = start
        group = np.cumsum(new) - 1
        tied = tied[np.bincount(group)[group] > 1]
        k *= 2
    return order


class WaveletMatrix:
    """Rank over a sequence of small numbers; one bit vector with running counts a level."""

    def __init__(self, seq: np.ndarray, top: int):
        self.levels = max(1, int(top).bit_length())
        self.zeros, self.ones = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            count = np.zeros(len(seq) + 1, dtype=np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(seq) - int(count[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``; both arrays."""
        low, high = np.zeros(len(at), dtype=np.int64), at.astype(np.int64)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbol >> level) & 1).astype(bool)
            a, b = self.ones[i][low], self.ones[i][high]
            low = np.where(one, self.zeros[i] + a, low - a)
            high = np.where(one, self.zeros[i] + b, high - b)
        return high - low


class FmIndex:
    """FM-index of a word-number sequence; numbers below ``plain`` can be searched, the last is not one of them."""

    def __init__(self, seq: np.ndarray, plain: int):
        self.n = len(seq)
        order = suffix_order(seq, plain)
        before = seq[order - 1]
        before[order == 0] = plain
        odd = before >= plain
        before = np.where(odd, plain, before)
        self.bwt = WaveletMatrix(before.astype(np.int64), plain)
        self.last = before
        self.first = np.searchsorted(seq[order], np.arange(plain + 1))
        self.sampled = odd | (order % SAMPLE == 0)
        self.place = np.cumsum(self.sampled) - 1
        self.kept = order[self.sampled]

    def find(self, phrases: list[np.ndarray] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases of one length, given as a matrix; empty where low == high."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, step]
            low[live] = self.first[c] + self.bwt.rank(c, low[live])
            high[live] = self.first[c] + self.bwt.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, walked backward to a sampled one."""
        rows, steps = rows.copy(), np.zeros(len(rows), dtype=np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            r = rows[live]
            c = self.last[r]
            rows[live] = self.first[c] + self.bwt.rank(c, r)
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.kept[self.place[rows]] + steps


class Phrases:
    """The windows of a set of test items, laid out as one sequence of word numbers (4 bytes a word) and window starts."""

    def __init__(self, items: list[tuple[object, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str] = []
        parts, sizes = [], []
        for key, text in items:
            seq = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if seq:
                self.ids.append("" if key is None else str(key))
                parts.append(np.array(seq, dtype=np.int32))
                sizes.append(len(seq))
        #: distinct ids in order, and the place of each item's id among them
        self.names = sorted(set(self.ids))
        place = {name: k for k, name in enumerate(self.names)}
        self.rank = np.array([place[i] for i in self.ids], dtype=np.int64)
        self.seq = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
        self.begin = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        size = np.minimum(np.array(sizes, dtype=np.int64), window)
        #: by length: where the windows of that length start
        self.groups: list[tuple[int, np.ndarray]] = []
        for n in np.unique(size).tolist():
            items_of = np.flatnonzero(size == n)
            count = np.diff(self.begin)[items_of] - n + 1
            starts = np.repeat(self.begin[items_of], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            self.groups.append((n, starts.astype(np.int64)))

    def scan(self, texts: list[bytes]) -> list[tuple[int, list[tuple[int, int]], np.ndarray]]:
        """Per text: its words, the merged word spans [from, to) of occurrences, and the places among ``names`` of the items found.

        Equal windows have one row range in the index: it is located once, whatever the number of its items. Each place of
        the text is the start of one distinct window of a length at most, so occurrences don't outgrow the text.
        """
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        plain = len(self.vocabulary)
        nothing = np.zeros(0, dtype=np.int64)
        if not self.groups or not sizes.sum():
            return [(int(n), [], nothing) for n in sizes]
        get = self.vocabulary.get
        # one more symbol after every document keeps occurrences inside it
        seq = np.fromiter((get(w, -1) for ws in words for w in (*ws, None)), dtype=np.int64, count=int(sizes.sum()) + len(words))
        odd = np.flatnonzero(seq < 0)
        seq[odd] = plain + np.arange(len(odd))
        index, begin = FmIndex(seq, plain), np.concatenate(([0], np.cumsum(sizes + 1)))
        cover = np.zeros(len(seq) + 1, dtype=np.int64)
        sets: dict[bytes, int] = {}  # of items, each kept once
        held: list[np.ndarray] = []
        pairs: list[np.ndarray] = []  # document and set
        for size, starts in self.groups:
            rows, items = [], []
            for a in range(0, len(starts), WINDOWS):
                own = starts[a : a + WINDOWS]
                low, high = index.find(self.seq[own[:, None] + np.arange(size)].astype(np.int64))
                found = np.flatnonzero(high > low)
                rows.append(np.stack((low[found], high[found])))
                items.append(self.rank[np.searchsorted(self.begin, own[found], side="right") - 1])
            both = np.concatenate(rows, axis=1)
            low, first, which = np.unique(both[0], return_index=True, return_inverse=True)
            if not len(low):
                continue
            count = both[1, first] - low
            of, item = np.divmod(np.unique(which * len(self.names) + np.concatenate(items)), len(self.names))
            own_sets = []
            for own in np.split(item, np.flatnonzero(np.diff(of)) + 1):
                number = sets.setdefault(own.tobytes(), len(sets))
                if number == len(held):
                    held.append(own)
                own_sets.append(number)
            own = np.repeat(np.arange(len(low)), count)
            at = index.locate(np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + low[own])
            cover += np.bincount(at, minlength=len(cover)) - np.bincount(at + size, minlength=len(cover))
            pairs.append(np.unique((np.searchsorted(begin, at, side="right") - 1) << 32 | np.array(own_sets)[own]))
        if not pairs:
            return [(int(n), [], nothing) for n in sizes]
        hit = np.concatenate(([0], (np.cumsum(cover) > 0).astype(np.int8), [0]))
        edges = np.flatnonzero(np.diff(hit)).reshape(-1, 2)
        owner = np.searchsorted(begin, edges[:, 0], side="right") - 1
        spans: dict[int, list[tuple[int, int]]] = {}
        for d, (a, b) in zip(owner.tolist(), (edges - begin[owner][:, None]).tolist(), strict=True):
            spans.setdefault(d, []).append((a, b))
        both = np.unique(np.concatenate(pairs))
        both = np.column_stack((both >> 32, both & 0xFFFFFFFF))
        unions: dict[tuple, np.ndarray] = {}  # documents with the same passages share their items
        out = [(int(n), [], nothing) for n in sizes]
        for own in np.split(both, np.flatnonzero(np.diff(both[:, 0])) + 1):
            d, key = int(own[0, 0]), tuple(own[:, 1].tolist())
            if key not in unions:
                unions[key] = np.unique(np.concatenate([held[k] for k in key]))
            out[d] = (out[d][0], spans[d], unions[key])
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "n_words long, hit_spans array<struct<start:int,end:int>>, hit_items array<string>"


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[object, bytes]]]:
    """The items in blocks of at most ``limit`` bytes of text, one block in memory at a time."""
    rows, size = [], 0
    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).toLocalIterator():
        text = bytes(row["text"])
        if rows and size + len(text) > limit:
            yield rows
            rows, size = [], 0
        rows.append((row["item_id"], text))
        size += len(text)
    if rows:
        yield rows


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """``docs`` (any columns; ``text``) with ``n_words``, ``hit_spans`` and ``hit_items``.

    ``benchmark`` has ``item_id`` and ``text``; it is the stated query set. A window is
    ``window`` consecutive words of an item; a shorter item with words is one window. Spans are
    word positions [start, end) that occurrences of windows cover, merged; ``hit_items`` holds
    the ids of the items with an occurrence, as strings in order. Null and empty texts have no
    words and no hits; equal items and repeated rows each count.

    An item whose id is null is searched as well and listed as ''. An empty benchmark hits nothing.

    Test items travel as word numbers in blocks of at most ``ITEMS_BYTES`` of text: up to there
    one pass searches all items in one index a shard; each further block is one more pass over
    the documents, whose spans are merged with those of the passes before.
    """
    spark = docs.sparkSession
    base = without(docs, "n_words", "hit_spans", "hit_items")
    keep = base.columns
    schema = schema_of(base, FOUND)

    def search(df: DataFrame, phrases, again: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = phrases.value
            held, size = [], 0
            for batch in slices(batches, "text", rows=1 << 20, size=SHARD_BYTES):
                held.append(batch)
                size += batch.column("text").nbytes
                if size >= SHARD_BYTES // 2:
                    yield from shard(own, held)
                    held, size = [], 0
            if held:
                yield from shard(own, held)

        def shard(own: Phrases, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held).combine_chunks()
            found = own.scan(utf8(whole.column("text").combine_chunks()))
            names = pa.array(own.names, type=pa.string())
            at = 0
            while at < whole.num_rows:  # lists of items are spelled out a stretch of documents at a time
                to, listed = at, 0
                while to < whole.num_rows and (to == at or listed + len(found[to][2]) <= LISTED):
                    listed, to = listed + len(found[to][2]), to + 1
                yield from spelled(names, whole.slice(at, to - at), found[at:to])
                at = to

        def spelled(names: pa.Array, rows: pa.Table, found: list) -> Iterator[pa.RecordBatch]:
            spans = [s for _, s, _ in found]
            ends = np.cumsum([0, *(len(x) for _, _, x in found)], dtype=np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), names.take(pa.array(np.concatenate([x for _, _, x in found]))))
            if again:
                before = [[(x["start"], x["end"]) for x in s] for s in rows.column("hit_spans").to_pylist()]
                spans = [merged(a + b) for a, b in zip(before, spans, strict=True)]
                both = [sorted({*a, *b}) for a, b in zip(rows.column("hit_items").to_pylist(), items.to_pylist(), strict=True)]
                items = pa.array(both, type=pa.list_(pa.string()))
            pairs = [[{"start": a, "end": b} for a, b in s] for s in spans]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            more = [pa.array([n for n, _, _ in found], type=pa.int64()), pa.array(pairs, type=kind), items]
            yield from pa.table([*(rows.column(c) for c in keep), *more], names=[*keep, "n_words", "hit_spans", "hit_items"]).to_batches()

        return df.mapInArrow(run, schema)

    out, again = base, False
    for block in _blocks(benchmark, ITEMS_BYTES):
        out, again = search(out, spark.sparkContext.broadcast(Phrases(block, window)), again), True
    return out if again else search(out, spark.sparkContext.broadcast(Phrases([], window)), False)


def judged(found: DataFrame) -> DataFrame:
    """``find_contamination`` rows with ``n_hit`` and ``contaminated``: a twentieth of the words or more, at least one."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op8_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document."""
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    out = judged(find_contamination(docs.select("doc_id", "text"), benchmark))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated",
    )


OP8_SQL = r"""
WITH i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), q AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[k : k + least(13, len(w)) - 1], ' ') AS g FROM i, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(k) WHERE len(w) > 0
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), p AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM d, (SELECT DISTINCT n FROM q), unnest(range(1, len(w) - n + 2)) AS t(k)
), f AS (
  SELECT doc_id, k, n, item FROM p JOIN q USING (n, g)
), h AS (
  SELECT doc_id, count(DISTINCT k + s) AS n_hit FROM f, unnest(range(n)) AS t(s) GROUP BY doc_id
), m AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN m USING (doc_id)
"""
