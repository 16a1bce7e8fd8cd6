"""Removal of long repeated word sequences, found by recompression.

Recompression (Jez, 2013) alternates two renaming rounds on a sequence of symbols, words at
first: a *run* round names every maximal run of one symbol, and a *pair* round, having split
the symbols into left and right ones, names every left symbol that a right one follows. A
name is a 64-bit function of what it stands for, so every executor gives one thing one name
and no dictionary has to travel. Whether two neighbours fuse depends on these two alone;
hence equal substrings are cut alike but for some symbols at their ends. The part that is
certain, whatever stands around, is the *core* of a window (see I, 2017, popped sequences).

The table is dealt to blocks of documents. Three rounds decide which windows of ``window`` words
recur; a block is recompressed once, when it is written, and keeps its anchors beside its texts:

1. Every window is anchored at the first symbol of its core on the highest level where it has
   one. Equal windows have equal anchors. Blocks send the distinct anchor names they hold to
   ranges of the name space; a range answers with one bit a name: does it occur twice?
2. Only windows on recurring anchors are verified: blocks send their 96-bit fingerprints,
   again to ranges, and again get one bit each.
3. Each block removes the words that recurring windows cover.

A block sends each name once, however often it holds it, and ranges split the name space
evenly, so no word, passage or group of copies can be hot. Names are never joined to rows.

Two windows are taken for equal if two hashes of 64 and 32 bits over the words' 64-bit names
are. Among n windows n^2 / 2^97 pairs of unequal ones are expected to agree by chance (for the
1.7e13 windows of 100 TB: 0.002), and among m distinct words m^2 / 2^65 pairs (1e9 words: 0.03).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, mix, read, schema_of, shared_dir, strings_hash, unused, utf8, without

#: The renaming rounds: R names runs, P names pairs.
ROUNDS = "RPPPRPPPP"
#: UTF-8 bytes of text to a block; bytes that are recompressed at once; most buckets of the block table (a bucket holds any number of blocks).
BLOCK_BYTES, CHUNK_BYTES, MOST_BUCKETS = 6 << 20, 3 << 20, 65_536
#: Bytes of a word from which it is hashed by itself.
LONG_WORD = 512
#: Bytes of text to a range of the name space, for anchors and for fingerprints; bytes of questions that a task packs together.
RANGE_BYTES, PACKED_BYTES = (64 << 20, 16 << 20), 8 << 20


def word_line(text: bytes) -> bytes:
    """The words of a text, one blank between two."""
    return b" ".join(text.split())


def name_words(lines: list[bytes]) -> np.ndarray:
    """64-bit names of the words of ``word_line`` texts, end to end: eight bytes at a time are mixed in, for all words at once.

    Words of up to eight bytes have different names for certain if their lengths are equal.
    """
    line = b" ".join([*filter(None, lines), bytes(8)])  # eight more bytes, so that every word can be read by eights
    ends = np.flatnonzero(np.frombuffer(line, dtype=np.uint8)[:-8] == 32)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    left = ends - starts
    eight = np.ndarray((len(line) - 7,), dtype="<u8", buffer=line, strides=(1,))
    out = mix(left.astype(np.uint64), 1)
    live = np.flatnonzero((left > 0) & (left <= LONG_WORD))
    at, left_of = starts[live], left[live]
    while len(live):
        short = np.uint64(8) * np.minimum(left_of, 8).astype(np.uint64)
        out[live] = mix(out[live], eight[at] & (~np.uint64(0) >> (np.uint64(64) - short)))
        more = left_of > 8
        live, at, left_of = live[more], at[more] + 8, left_of[more] - 8
    long = np.flatnonzero(left > LONG_WORD)
    out[long] = strings_hash([line[a:b] for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)], 1)
    return out


def anchors(names: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, anchor name and anchor occurrence of every window.

    ``names``: word names of documents laid end to end; ``first``: True where a document
    begins. An occurrence is a number that two windows share if one symbol anchors both.
    """
    n = len(names)
    doc = np.cumsum(first)
    starts = np.arange(max(0, n - window + 1))
    starts = starts[doc[starts] == doc[starts + window - 1]] if len(starts) else starts
    who, own = np.zeros(len(starts), dtype=np.uint64), np.zeros(len(starts), dtype=np.int64)
    live, left, right = np.arange(len(starts)), starts.copy(), starts + window - 1
    sym, head, base = names, first, 0
    if not len(starts):
        return starts, who, own
    who[:], own[:] = sym[left], left
    for level, kind in enumerate(ROUNDS, 1):
        same_doc = ~head[1:]
        if kind == "R":
            fuse = np.concatenate(([False], (sym[1:] == sym[:-1]) & same_doc))
        else:
            is_left = (mix(sym, 1000 + level) >> np.uint64(17)) & np.uint64(1) == 1
            fuse = np.concatenate(([False], is_left[:-1] & ~is_left[1:] & same_doc))
        begin = np.flatnonzero(~fuse)
        to = np.cumsum(~fuse) - 1
        size = np.diff(np.append(begin, len(sym)))
        new = sym[begin].copy()
        many = np.flatnonzero(size > 1)
        if kind == "R":
            new[many] = mix(new[many], mix(size[many].astype(np.uint64), 77 + level))
            left, right = to[left] + 1, to[right] - 1
        else:
            new[many] = mix(mix(new[many], 55 + level), sym[begin[many] + 1])
            left, right = to[np.minimum(left + ~is_left[left], len(sym) - 1)] + (left + ~is_left[left] >= len(sym)), to[right - is_left[right]]
        base += len(sym)
        sym, head = new, head[begin]
        alive = left <= right
        live, left, right = live[alive], left[alive], right[alive]
        if not len(live):
            break
        who[live], own[live] = mix(sym[left], 9000 + level), base + left
    return starts, who, own


def window_prints(names: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of every window: 64 bits by doubling, 32 bits by a second, polynomial hash."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint32)
    power, size, out, at = names, 1, None, 0
    rest = window
    while rest:
        if rest & 1:
            piece = power[starts + at]
            out = mix(piece, size) if out is None else mix(out, piece)
            at += size
        rest >>= 1
        if rest:
            power = mix(power[:-size], power[size:])
            size *= 2
    with np.errstate(over="ignore"):
        # a number for the word times r^i, i counted in the window: sums of r^i words, moved to the window's start
        r, inverse = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
        up = np.cumprod(np.full(len(names), r))
        down = np.cumprod(np.full(len(names), inverse))
        sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(names, 31) * up)))
        poly = (sums[starts + window] - sums[starts]) * down[starts]
    return out, (poly >> np.uint64(32)).astype(np.uint32)


class Block:
    """The words of one block's documents and the windows that may recur."""

    def __init__(self, texts: list[bytes], window: int):
        self.window, self.lines = window, [word_line(t) for t in texts]
        self.sizes = np.array([x.count(b" ") + 1 if x else 0 for x in self.lines], dtype=np.int64)
        self.offset = np.concatenate(([0], np.cumsum(self.sizes)))
        self.names = name_words(self.lines)

    def windows(self) -> np.ndarray:
        """Starts of all windows, in order."""
        count = np.maximum(self.sizes - self.window + 1, 0)
        return np.repeat(self.offset[:-1], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)

    def anchored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor names in order; whether the block itself holds each twice; runs of windows on one name: lengths, names' places."""
        who, own, base, at = [], [], 0, 0
        while at < len(self.sizes):
            to = at + 1
            while to < len(self.sizes) and (self.offset[to + 1] - self.offset[at]) * 8 < CHUNK_BYTES:
                to += 1
            a, b = self.offset[at], self.offset[to]
            first = np.zeros(b - a, dtype=bool)
            first[(self.offset[at:to] - a)[self.sizes[at:to] > 0]] = True
            _, names, places = anchors(self.names[a:b], first, self.window)
            who.append(names)
            own.append(places + base)
            base += (len(ROUNDS) + 1) * int(b - a) + 1  # more than any place of the chunk
            at = to
        who, own = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (who, own))
        pick = np.unique(own, return_index=True)[1]
        names, count = np.unique(who[pick].astype(np.uint64), return_counts=True)
        edge = np.flatnonzero(np.concatenate((np.ones(min(len(who), 1), dtype=bool), who[1:] != who[:-1])))
        return names, count > 1, np.diff(np.append(edge, len(who))), np.searchsorted(names, who[edge].astype(np.uint64))

    def prints(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct fingerprints of the windows in order, their second part, whether twice here; each window's place."""
        a, b = window_prints(self.names, starts, self.window)
        order = np.argsort(a, kind="stable")
        if len(a) and ((a[order][1:] == a[order][:-1]) & (b[order][1:] != b[order][:-1])).any():
            order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, dtype=bool)
        place = np.empty(len(a), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        count = np.bincount(place, minlength=int(new.sum()))
        return a[new], b[new], count > 1, place


def _arrays(*arrays: np.ndarray) -> bytes:
    """Arrays in one byte string; ``_read`` gives them back."""
    sink = pa.BufferOutputStream()
    for x in arrays:
        pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(x)), sink)
    return sink.getvalue().to_pybytes()


def _read(blob: bytes, n: int) -> list[np.ndarray]:
    source = pa.BufferReader(blob)
    return [pa.ipc.read_tensor(source).to_numpy() for _ in range(n)]


def _ranges(names: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, from, to) of the parts of a sorted name array that fall in equal ranges of the name space."""
    if not len(names):
        return []
    own = ((names >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    return list(zip(own[at].astype(np.int64).tolist(), at.tolist(), [*at[1:].tolist(), len(names)], strict=True))


#: A question packs, for one range, the names of several blocks: block numbers and sizes (int32), names, second parts, bits.
ASK = "rng int, blks binary, sizes binary, names binary, more binary, twice binary"
ANSWER = "blk int, rng int, bits binary"
_ASK = pa.schema([("rng", pa.int32())] + [(c, pa.binary()) for c in ("blks", "sizes", "names", "more", "twice")])


def _packed(blocks: Iterator[tuple], ranges: int) -> Iterator[pa.RecordBatch]:
    """Questions of (block, names, second parts, twice), packed by range as they come."""
    held: dict[int, list] = {}
    size = 0

    def flush():
        rows = [(r, np.array([x[0] for x in q], dtype=np.int32).tobytes(), np.array([x[1] for x in q], dtype=np.int32).tobytes(), *(b"".join(x[k] for x in q) for k in (2, 3, 4))) for r, q in held.items()]
        for a in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows[a : a + 10_000], strict=True), _ASK, strict=True)], schema=_ASK)
        held.clear()

    for blk, names, more, twice in blocks:
        for r, a, b in _ranges(names, ranges):
            held.setdefault(r, []).append((blk, b - a, names[a:b].tobytes(), b"" if more is None else more[a:b].tobytes(), np.packbits(twice[a:b]).tobytes()))
        size += names.nbytes + (0 if more is None else more.nbytes)
        if size >= PACKED_BYTES:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def _answers(asked: pa.Table) -> pa.Table:
    """One range: which of its names occur twice, over all blocks, as bits for every block that holds such a name."""
    rng = asked.column("rng")[0].as_py()
    rows = asked.to_pylist()
    ints = lambda c: np.concatenate([np.frombuffer(r[c], dtype=np.int32) for r in rows])
    blks, sizes = ints("blks"), ints("sizes").astype(np.int64)
    names = np.concatenate([np.frombuffer(r["names"], dtype=np.uint64) for r in rows])
    more = b"".join(r["more"] for r in rows)
    second = np.frombuffer(more, dtype=np.uint32) if more else np.zeros(len(names), dtype=np.uint32)
    # the bits of every block begin at a byte
    bits, begin = np.frombuffer(b"".join(r["twice"] for r in rows), dtype=np.uint8), np.concatenate(([0], np.cumsum(-(-sizes // 8))))
    twice = np.concatenate([np.unpackbits(bits[a:b], count=n) for a, b, n in zip(begin[:-1].tolist(), begin[1:].tolist(), sizes.tolist(), strict=True)])
    order = np.argsort(names, kind="stable")
    a, b = names[order], second[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any():
        order = np.lexsort((second, names))
        a, b = names[order], second[order]
    group = np.cumsum(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) - 1
    votes = np.bincount(group, weights=1 + twice[order])
    found = np.empty(len(names), dtype=bool)
    found[order] = votes[group] > 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    some = np.flatnonzero(np.add.reduceat(found, at[:-1]))
    out = [np.packbits(found[at[k] : at[k + 1]]).tobytes() for k in some.tolist()]
    return pa.table([pa.array(blks[some]), pa.array(np.full(len(some), rng, dtype=np.int32)), pa.array(out, type=pa.binary())], names=["blk", "rng", "bits"])


def _bits(answers: list[dict], ranges: int, names: np.ndarray) -> np.ndarray:
    """The answers to a block's questions, laid along its sorted names."""
    out, places = np.zeros(len(names), dtype=bool), {r: (a, b) for r, a, b in _ranges(names, ranges)}
    for r in answers:
        a, b = places[r["rng"]]
        out[a:b] = np.unpackbits(np.frombuffer(r["bits"], dtype=np.uint8), count=b - a).astype(bool)
    return out


def _candidates(block: Block, state: bytes, answers: list[dict], ranges: int) -> np.ndarray:
    """Starts of the windows whose anchor recurs."""
    names, lengths, places = _read(state, 4)[:3]
    return block.windows()[np.repeat(_bits(answers, ranges, names)[places], lengths)]


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """``docs`` (any columns; ``doc_id``, ``text``) with ``n_words``, ``n_removed`` and ``kept_text``.

    A word is removed if a window of ``window`` words of its document covers it whose word
    sequence starts anywhere else as well, in this document or another; all windows are judged
    on the input. ``kept_text`` has the kept words joined by one space. Documents shorter than
    a window lose nothing; a null or empty text has no words and gives an empty ``kept_text``.
    A repeated row is a document of its own, so its windows recur. Input columns named as
    outputs give way to them. Rows return in no set order. Rows are numbered as they are read, so
    ``docs`` should come from files or a checkpoint, not from an unsettled shuffle. Runs jobs when called; the blocks
    are kept in the shared folder, as a table whose entry in the catalogue is dropped again.
    """
    spark = docs.sparkSession
    docs = without(docs, "n_words", "n_removed", "kept_text")
    blk, state = unused(docs, "blk", "state")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(1 + total // BLOCK_BYTES)
    buckets = min(blocks, MOST_BUCKETS)
    anchor_ranges, print_ranges = (int(max(8, 1 + total // n)) for n in RANGE_BYTES)
    # rows are dealt by their number, settled once the blocks are written: no id, source or group of copies weighs on one block
    key = F.xxhash64(F.monotonically_increasing_id())
    dealt = docs.withColumn(blk, F.pmod(key, F.lit(blocks)).cast("int")).repartition(buckets, blk)
    schema = schema_of(dealt, f"{state} binary")

    def prepare(rows: pa.Table) -> pa.Table:
        names, twice, lengths, places = Block(utf8(rows.column("text").combine_chunks()), window).anchored()
        own = _arrays(names, lengths.astype(np.uint32), places.astype(np.uint32), np.packbits(twice))
        return rows.append_column(state, pa.array([own, *[None] * (rows.num_rows - 1)], type=pa.binary()))

    table = fresh("text_blocks")
    path = f"{shared_dir(spark).rstrip('/')}/{table}"
    writer = dealt.groupBy(blk).applyInArrow(prepare, schema).write.bucketBy(buckets, blk).option("path", path)
    writer.format("parquet").saveAsTable(table)
    held = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay

    def ask_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks_of():
            for batch in batches:
                for own, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    names, _, _, twice = _read(blob.as_py(), 4)
                    yield own, names, None, np.unpackbits(twice, count=len(names)).astype(bool)

        return _packed(blocks_of(), anchor_ranges)

    def answered(asked: DataFrame) -> DataFrame:
        return cut(asked.groupBy("rng").applyInArrow(_answers, ANSWER))

    first = answered(held.where(F.col(state).isNotNull()).select(blk, state).mapInArrow(ask_anchors, ASK))

    def ask_prints(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([[]] * 4, schema=_PRINTS)
        block = Block(utf8(left.column("text").combine_chunks()), window)
        a, b, twice, _ = block.prints(_candidates(block, _only(left.column(state)), right.to_pylist(), anchor_ranges))
        return pa.table([[left.column(blk)[0].as_py()], [a.tobytes()], [b.tobytes()], [np.packbits(twice).tobytes()]], schema=_PRINTS)

    def pack_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks_of():
            for batch in batches:
                for r in batch.to_pylist():
                    names = np.frombuffer(r["names"], dtype=np.uint64)
                    yield r["blk"], names, np.frombuffer(r["more"], dtype=np.uint32), np.unpackbits(np.frombuffer(r["twice"], dtype=np.uint8), count=len(names)).astype(bool)

        return _packed(blocks_of(), print_ranges)

    narrow = held.select(blk, "text", state).groupBy(blk)
    prints = narrow.cogroup(first.groupBy("blk")).applyInArrow(ask_prints, "blk int, names binary, more binary, twice binary")
    second = answered(prints.mapInArrow(pack_prints, ASK))
    keep = [c for c in held.columns if c not in (blk, state)]

    def removed(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        block = Block(utf8(left.column("text").combine_chunks()) if left.num_rows else [], window)
        gone = np.zeros(len(block.names), dtype=bool)
        if left.num_rows:
            answers = right.to_pylist()
            starts = _candidates(block, _only(left.column(state)), [r for r in answers if not r["kind"]], anchor_ranges)
            found, _, _, place = block.prints(starts)
            hit = starts[_bits([r for r in answers if r["kind"]], print_ranges, found)[place]] if len(found) else starts[:0]
            step = np.bincount(hit, minlength=len(gone) + 1) - np.bincount(hit + window, minlength=len(gone) + 1)
            gone = np.cumsum(step[:-1]) > 0
        lost = np.concatenate(([0], np.cumsum(gone)))
        lost = lost[block.offset[1:]] - lost[block.offset[:-1]]
        kept = block.lines
        for k in np.flatnonzero(lost).tolist():
            mask = gone[block.offset[k] : block.offset[k + 1]].tolist()
            kept[k] = b" ".join([w for w, out in zip(kept[k].split(b" "), mask, strict=True) if not out])
        columns = [left.column(c) for c in keep]
        more = [pa.array(block.sizes), pa.array(lost.astype(np.int64)), pa.array(kept, type=pa.binary()).cast(pa.string())]
        return pa.table([*columns, *more], names=[*keep, "n_words", "n_removed", "kept_text"])

    answers = first.withColumn("kind", F.lit(0)).union(second.withColumn("kind", F.lit(1)))
    out = schema_of(held.select(keep), "n_words long, n_removed long, kept_text string")
    return held.groupBy(blk).cogroup(answers.groupBy("blk")).applyInArrow(removed, out)


_PRINTS = pa.schema([("blk", pa.int32()), ("names", pa.binary()), ("more", pa.binary()), ("twice", pa.binary())])


def _only(column: pa.ChunkedArray) -> bytes:
    """The one value of a column that is not null."""
    return column.drop_null()[0].as_py()


def op1_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept and removed of every document, with the digest of what is kept."""
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), p AS (
  SELECT doc_id, i, array_to_string(w[i : i + 34], ' ') AS g FROM d, unnest(range(1, len(w) - 33)) AS t(i)
), r AS (
  SELECT g FROM p GROUP BY g HAVING count(*) > 1
), h AS (
  SELECT DISTINCT doc_id, i + k AS j FROM p JOIN r USING (g), unnest(range(35)) AS t(k)
), x AS (
  SELECT doc_id, j, w[j] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(j)
), k AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS kept, count(*) AS n FROM x ANTI JOIN h USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
