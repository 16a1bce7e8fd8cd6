"""Best-fit packing of token sequences with a bounded number of open bins.

Texts are cut to token ids by a public byte-level BPE; a document's ids end with a terminator.
Documents longer than a sequence are cut into whole pieces, the first of which is shorter.

The packer is online with bounded space. Pieces arrive in an order set by a hash, a buffer of
``BUFFER`` at a time, of which the longest are put first. A piece goes to the open bin with the
least free space that holds it; a bitset with one bit a free-space value finds that bin in one
step. At most ``OPEN_BINS`` bins are open, fewer than a buffer of pieces fills: when one more is
needed, the fullest closes. Bins that a buffer leaves open wait for the next buffers' pieces.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_texts, read, schema_of, unused, without

#: Tokens of a sequence; open bins of a packer; pieces of its buffer; pieces that one packer is fed, about.
CAPACITY, OPEN_BINS, BUFFER, GROUP_PIECES = 2048, 1024, 4096, 200_000


def default_tokenizer() -> str:
    """Path of the byte-level BPE with 50,257 ids: one base64 token and its rank a line. The same file as .json stands beside it."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


# Fixed value: how byte-level BPE of this family cuts a text before it merges bytes.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


#: White space in runs of this length goes to the tokenizer itself: the faster reader's pattern matcher has a bounded stack.
LONG_RUN = 20_000
_LONG_BLANK = re.compile(r"\s{%d}" % LONG_RUN)


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, those of byte_bpe_50k.json.

    The ids come from a reader of the same ranks that is several times faster (tests compare the
    two); texts with very long runs of white space are left to the tokenizer. Text that spells the
    special token is that token, as by the tokenizer's defaults, unless ``special`` is false.
    """

    def __init__(self, path: str, special: bool = True):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        self.fast = partial(bpe.encode, allowed_special="all", disallowed_special=()) if special else bpe.encode_ordinary
        self.path, self.special, self.slow = path, special, None

    def _tokenizer(self, text: str) -> list[int]:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path.removesuffix(".tiktoken") + ".json")
            self.slow.encode_special_tokens = not self.special
        return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> bytes:
        ids = self._tokenizer(text) if len(text) >= LONG_RUN and _LONG_BLANK.search(text) else self.fast(text)
        return struct.pack(f"<{len(ids)}I", *ids)


PIECES = "doc_id {kind}, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, terminator: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ``ids`` (binary).

    A null or empty text is the terminator alone. A repeated row gives its pieces again. The
    special token's string is that token; texts are encoded whole, whatever their length.
    """
    path = tokenizer or default_tokenizer()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def make():
        encode = Encoder(path)
        end = np.array([terminator], dtype="<u4").tobytes()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            take, rows, blobs = [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                ids = encode(text or "") + end
                n = len(ids) // 4
                first = n if n <= capacity else (n % capacity or capacity)
                at, piece = 0, 0
                while at < n:
                    size = first if piece == 0 else capacity
                    own = ids[4 * at : 4 * (at + size)]
                    rows.append((piece, at, size, zlib.crc32(own)))
                    take.append(k)
                    if with_ids:
                        blobs.append(own)
                    at, piece = at + size, piece + 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            arrays = [batch.column("doc_id").take(pa.array(take, type=pa.int64())), pa.array(cols[0], type=pa.int32()), *(pa.array(c, type=pa.int64()) for c in cols[1:])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(blobs, type=pa.binary()))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        return f

    return map_texts(docs.select("doc_id", "text"), make, PIECES.format(kind=kind) + (", ids binary" if with_ids else ""))


class Packer:
    """Online best-fit over a fixed number of open bins."""

    def __init__(self, capacity: int, most: int = OPEN_BINS):
        self.capacity, self.most = capacity, most
        self.free = 0  # bit f is set if an open bin has f places free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def put(self, size: int) -> tuple[int, int]:
        """Bin number and offset of a piece."""
        fit = self.free >> size
        if fit:
            space = (fit & -fit).bit_length() - 1 + size
            own = self._take(space)
        else:
            if self.open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
            own, space = self.made, self.capacity
            self.made += 1
        if left := space - size:
            self.bins[left].append(own)
            self.free |= 1 << left
            self.open += 1
        return own, self.capacity - space

    def _take(self, space: int) -> int:
        own = self.bins[space].pop()
        if not self.bins[space]:
            self.free &= ~(1 << space)
        self.open -= 1
        return own


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, group: int = GROUP_PIECES, buffer: int = BUFFER) -> DataFrame:
    """``pieces`` (any columns; ``length``, 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Pieces are dealt to groups of about ``group``, one packer each, and arrive there by hash of
    their columns, so that no source or document weighs on one group; repeated rows are dealt
    alike but are packed each. No pieces, no sequences. Runs a count when called.
    """
    rows = without(pieces, "sequence_id", "offset")
    n = rows.count()
    groups = max(1, -(-n // group))
    keep = list(rows.columns)
    keys = [c for c in keep if c in ("doc_id", "piece", "start")] or keep
    own_group, arrival = unused(rows, "group", "arrival")
    dealt = rows.withColumn(own_group, F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int")).withColumn(arrival, F.xxhash64(F.lit(1), *keys))
    dealt = dealt.repartition(groups, own_group).sortWithinPartitions(own_group, arrival, *keys).drop(arrival)
    schema = schema_of(rows, "sequence_id long, offset long")

    def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
        """Tables of ``buffer`` rows, or what is left, of one group each."""
        held, size = [], 0
        for batch in batches:
            at, owner = 0, batch.column(own_group).to_numpy()
            while at < batch.num_rows:
                if held and held[0].column(own_group)[0].as_py() != owner[at]:
                    yield held[0].column(own_group)[0].as_py(), pa.Table.from_batches(held)
                    held, size = [], 0
                to = min(int(np.searchsorted(owner, owner[at], side="right")), at + buffer - size)
                held.append(batch.slice(at, to - at))
                size, at = size + to - at, to
                if size == buffer:
                    yield int(owner[to - 1]), pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield held[0].column(own_group)[0].as_py(), pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, now = None, None
        for g, table in buffers(batches):
            if g != now:
                packer, now = Packer(capacity, open_bins), g
            sizes = table.column("length").to_numpy()
            ids, places = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
            for k in np.argsort(-sizes, kind="stable").tolist():
                own, places[k] = packer.put(int(sizes[k]))
                ids[k] = (g << 40) + own
            table = table.select(keep).append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(places))
            yield from table.combine_chunks().to_batches()

    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (``doc_id``, ``text``; other columns are left out)."""
    return pack(cut(token_pieces(docs, tokenizer, capacity)), capacity)


def op9_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return pack_documents(read(spark, sf_dir, "documents"))
