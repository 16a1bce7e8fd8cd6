"""Token ids as files of fixed-width bit packing.

A file holds the ids of documents in order, each in the fewest bits that number the vocabulary,
the lowest bit first. Ids are laid in blocks of ``BLOCK_IDS``, each starting on a byte, so that any
stretch is read by seeking to its blocks and unpacked by numpy eight ids at a time. Behind the
blocks stand two tables as Arrow streams, the offset of every block and the first id of every
document, then their lengths (two unsigned 64-bit numbers) and the mark:

    mark, blocks, documents (doc_id, first), blocks (offset), length, length, mark

Spark reads and writes the files as the data source ``packed_ids``. Each task writes files of its own
names; the commit lists those of the tasks that succeeded, in order, in ``manifest.json`` with the number
of ids before each, so a lost or repeated task leaves nothing behind that is read. Files go through
``pyarrow.fs``, to whatever store it knows by the folder's address.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import fresh, read, shared_dir, slices, utf8

MARK = b"PWIDS001"
#: Ids of a block (a multiple of 8); ids and documents after which a task starts another file; ids of a batch read back.
BLOCK_IDS, FILE_IDS, FILE_DOCS, BATCH_IDS = 8192, 64 << 20, 1 << 20, 1 << 20
#: Words, and pieces of words, whose ids are remembered; those of more bytes than this are encoded anew in each batch.
CACHE_WORDS, CACHE_PIECES, CACHE_WORD = 500_000, 1_000_000, 64


def width_of(vocabulary: int) -> int:
    """The fewest bits that number ``vocabulary`` ids."""
    return max(1, (vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each (32 at most), lowest first, filled to whole bytes with zeros."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id takes more than {bits} bits")
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    groups = -(-len(ids) // 8)
    whole = np.zeros((groups, 8), dtype="<u8")
    whole.ravel()[: len(ids)] = ids
    out = np.zeros((groups, bits + 8), dtype=np.uint8)
    for k in range(8):  # the k-th id of every eight lies at bit k * bits of its group
        at = k * bits // 8
        out[:, at : at + 8] |= np.ascontiguousarray(whole[:, k] << np.uint64(k * bits % 8)).view(np.uint8).reshape(groups, 8)
    return out[:, :bits].tobytes()[: -(-len(ids) * bits // 8)]


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of packed bytes, as unsigned 32-bit numbers."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, dtype=f"<u{bits // 8}", count=n).astype("<u4")
    groups = -(-n // 8)
    whole = np.zeros((groups, bits + 8), dtype=np.uint8)
    whole[:, :bits] = np.frombuffer(data.ljust(groups * bits, b"\0")[: groups * bits], dtype=np.uint8).reshape(groups, bits)
    out = np.empty((groups, 8), dtype="<u4")
    for k in range(8):
        at = k * bits // 8
        words = np.ascontiguousarray(whole[:, at : at + 8]).view("<u8").ravel()
        out[:, k] = (words >> np.uint64(k * bits % 8)) & np.uint64((1 << bits) - 1)
    return out.ravel()[:n]


def _folder(address: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and plain path of a folder."""
    for hadoop in ("s3a://", "s3n://"):
        address = address.replace(hadoop, "s3://", 1) if address.startswith(hadoop) else address
    return pa.fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (pa.fs.LocalFileSystem(), address)


class _File:
    """One file being written; ids come in stretches and leave in whole blocks."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, bits: int, kind: pa.DataType):
        self.out, self.bits, self.kind = fs.open_output_stream(path), bits, kind
        self.out.write(MARK)
        self.at, self.ids, self.offsets = len(MARK), 0, []
        self.docs: list[pa.Array] = []
        self.first: list[np.ndarray] = []
        self.n_docs, self.rest = 0, np.zeros(0, dtype=np.uint32)

    def add(self, docs: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs.take(pa.array(range(len(docs)))))  # a copy, so that the batch with its ids can go
        self.first.append(self.ids + np.cumsum(sizes) - sizes)
        self.ids, self.n_docs = self.ids + len(ids), self.n_docs + len(docs)
        held = np.concatenate((self.rest, ids))
        whole = len(held) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, whole, BLOCK_IDS):
            self._block(held[at : at + BLOCK_IDS])
        self.rest = held[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack_bits(ids, self.bits)
        self.offsets.append(self.at)
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        doc_id = pa.chunked_array(self.docs, type=self.kind)
        first = pa.array(np.concatenate(self.first) if self.first else np.zeros(0, dtype=np.int64), type=pa.int64())
        about = {"bits": str(self.bits), "block_ids": str(BLOCK_IDS), "ids": str(self.ids)}
        sizes = []
        for table in (pa.table({"doc_id": doc_id, "first": first}), pa.table({"offset": pa.array(self.offsets, type=pa.int64())}).replace_schema_metadata(about)):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            sizes.append(len(data := sink.getvalue()))
            self.out.write(data)
        self.out.write(struct.pack("<QQ", *sizes) + MARK)
        self.out.close()


class PackedFile:
    """A file opened for reading: any stretch of its ids, or a document's, without reading the rest."""

    def __init__(self, fs: pa.fs.FileSystem, path: str):
        self.file = fs.open_input_file(path)
        end = self.file.size() - len(MARK) - 16
        self.file.seek(end)
        tail = self.file.read()
        if tail[16:] != MARK:
            raise ValueError(f"not a file of packed ids: {path}")
        docs, blocks = struct.unpack("<QQ", tail[:16])
        self.file.seek(end - docs - blocks)
        data = self.file.read(docs + blocks)
        self.docs, self.blocks = (pa.ipc.open_stream(d).read_all() for d in (data[:docs], data[docs:]))
        about = {k.decode(): int(v) for k, v in self.blocks.schema.metadata.items()}
        self.bits, self.block_ids, self.n = about["bits"], about["block_ids"], about["ids"]
        self.first = np.append(self.docs.column("first").to_numpy(), self.n)
        self.offset = np.append(self.blocks.column("offset").to_numpy(), end - docs - blocks)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids number ``start`` up to ``end`` of the file."""
        if end <= start:
            return np.zeros(0, dtype=np.uint32)
        low, high = start // self.block_ids, (end - 1) // self.block_ids
        self.file.seek(int(self.offset[low]))
        data = self.file.read(int(self.offset[high + 1] - self.offset[low]))
        # blocks hold a multiple of eight ids, so a run of blocks unpacks as one
        own = unpack_bits(data, self.bits, min((high + 1) * self.block_ids, self.n) - low * self.block_ids)
        return own[start - low * self.block_ids : end - low * self.block_ids]

    def document(self, at: int) -> np.ndarray:
        """The ids of the file's ``at``-th document."""
        return self.ids(int(self.first[at]), int(self.first[at + 1]))


@dataclass
class _Written(WriterCommitMessage):
    """What one task wrote: its place in the order, and (name, documents, ids) of its files."""

    part: int
    files: list[tuple[str, int, int]]


class _Writer(DataSourceArrowWriter):
    """Writes rows of ids, or of texts that a tokenizer encodes, in the order of partitions and of the rows in them."""

    def __init__(self, path: str, bits: int, kind: str, overwrite: bool, tokenizer: str | None, end: int):
        self.path, self.bits, self.kind, self.overwrite = path, bits, kind, overwrite
        self.tokenizer, self.end = tokenizer, end

    def _ids(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """Document ids, how many ids each has, and all ids. A null list is empty, a null text the end id alone."""
        if self.tokenizer is None:
            for batch in batches:
                lists = batch.column("ids")
                lists = lists.fill_null([]) if lists.null_count else lists
                yield batch.column("doc_id"), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy().astype(np.uint32)
            return
        encode, last = word_encoder(self.tokenizer), struct.pack("<I", self.end)
        for batch in slices(batches, "text"):
            blobs = [b + last for b in encode(utf8(batch.column("text")))]
            yield batch.column("doc_id"), np.array([len(b) // 4 for b in blobs], dtype=np.int64), np.frombuffer(b"".join(blobs), dtype="<u4")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = _folder(self.path)
        fs.create_dir(folder, recursive=True)
        part, run = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        out, now = [], None
        for docs, sizes, ids in self._ids(iterator):
            if now is None:
                name = f"part-{part:06d}-{len(out):04d}-{run}.ids"
                now = _File(fs, f"{folder}/{name}", self.bits, docs.type)
                out.append((name, now))
            now.add(docs, sizes, ids)
            if now.ids >= FILE_IDS or now.n_docs >= FILE_DOCS:
                now.close()
                now = None
        if now:
            now.close()
        return _Written(part, [(name, f.n_docs, f.ids) for name, f in out])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """List the files in order with the ids before each; the list appears at once or not at all."""
        fs, folder = _folder(self.path)
        fs.create_dir(folder, recursive=True)
        at, files = 0, []
        for m in sorted((m for m in messages if m), key=lambda m: m.part):
            for name, docs, ids in m.files:
                files.append({"name": name, "docs": docs, "ids": ids, "start": at})
                at += ids
        place = f"{folder}/manifest.json"
        if fs.get_file_info(place).type != pa.fs.FileType.NotFound and not self.overwrite:
            raise FileExistsError(f"{self.path} holds token files; write to another folder or overwrite")
        with fs.open_output_stream(f"{place}.new") as out:
            out.write(json.dumps({"bits": self.bits, "doc_id": self.kind, "ids": at, "files": files}).encode())
        fs.move(f"{place}.new", place)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Remove what tasks reported; files of tasks that failed are in no manifest."""
        fs, folder = _folder(self.path)
        for m in messages:
            for name, _, _ in m.files if m else []:
                fs.delete_file(f"{folder}/{name}")


@dataclass
class _Part(InputPartition):
    name: str
    start: int


class _Reader(DataSourceReader):
    """Documents of the files that the manifest names, one partition a file."""

    def __init__(self, path: str, binary: bool):
        self.path, self.binary = path, binary

    def partitions(self) -> list[InputPartition]:
        return [_Part(f["name"], f["start"]) for f in manifest(self.path)["files"]] or [_Part("", 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        fs, folder = _folder(self.path)
        own = PackedFile(fs, f"{folder}/{partition.name}")
        at, n = 0, len(own.first) - 1
        doc_id = own.docs.column("doc_id").combine_chunks()
        while at < n:
            to = max(at + 1, int(np.searchsorted(own.first, own.first[at] + BATCH_IDS, side="right")) - 1)
            first = own.first[at : to + 1]
            ids = own.ids(int(first[0]), int(first[-1]))
            offsets = (first - first[0]).astype(np.int32)
            if self.binary:
                lists = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids.astype("<u4"))])
            else:
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([doc_id.slice(at, to - at), pa.array(partition.start + first[:-1]), lists], names=["doc_id", "start", "ids"])
            at = to


def manifest(path: str) -> dict:
    """The list of a folder's files: bits, doc_id (type), ids, files (name, docs, ids, start)."""
    fs, folder = _folder(path)
    with fs.open_input_stream(f"{folder}/manifest.json") as held:
        return json.loads(held.read())


class PackedIds(DataSource):
    """Data source ``packed_ids``. Columns written: doc_id and ids (array<int>), or doc_id and text with the option ``tokenizer`` (a file) that encodes it.

    Options: path; for writing ``bits`` (default 32), ``tokenizer`` and ``end`` (the id behind each text);
    for reading ``binary`` (ids as little-endian 32-bit numbers, not as an array).
    """

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        ids = "binary" if self._binary() else "array<int>"
        return f"doc_id {manifest(self.options['path'])['doc_id']}, start long, ids {ids}"

    def _binary(self) -> bool:
        return self.options.get("binary", "false") == "true"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._binary())

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        kind = schema["doc_id"].dataType.simpleString()
        return _Writer(self.options["path"], int(self.options.get("bits", 32)), kind, overwrite, self.options.get("tokenizer"), int(self.options.get("end", 0)))


# Fixed value: how the tokenizer cuts lower-cased words of ASCII and Latin-1 letters, read off its file: its
# classes of letters, digits and the rest, spelled out for these characters.
PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Words of these characters alone are cut by ``PIECES``; others, and what may spell a special token, go to the tokenizer whole.
_PLAIN = re.compile("[\x00-\x7fÀ-ÖØ-öø-ÿ]*")


class WordEncoder:
    """Ids of whole texts by a tokenizer, as little-endian 32-bit numbers, one bytes object a text.

    The tokenizer is one whose tokens never reach over white space and which drops white space, so the
    ids of a text are those of the stretches between ASCII blanks, one after the other; and those of
    a stretch of plain characters are those of its pieces, which go to the tokenizer's model as they are. Each
    distinct piece, or odd stretch, is encoded once; both are remembered, up to a number of each.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # the model reads bytes as characters; the library itself says which
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.table = {c: spelled(chr(c))[0][0] for c in range(256) if _PLAIN.fullmatch(chr(c))}
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encoded(self, pieces: list[str]) -> Iterator[bytes]:
        """Ids of pieces by the model, packed together and cut apart again."""
        tokens = list(map(self.model.tokenize, [p.translate(self.table) for p in pieces]))
        ids = np.array([t.id for own in tokens for t in own], dtype="<u4").tobytes()
        ends = [0, *(4 * np.cumsum(list(map(len, tokens)), dtype=np.int64)).tolist()]
        return (ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True))

    def _learn(self, words: list[bytes]) -> None:
        """Remember the ids of new words."""
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if _PLAIN.fullmatch(t) and "<|" not in t]
        cut = [PIECES.findall(texts[i].lower()) for i in plain]
        new = list(set(chain.from_iterable(cut)).difference(self.pieces))
        self.pieces.update(zip(new, self._encoded(new), strict=True))
        get = self.pieces.__getitem__
        self.words.update((words[i], b"".join(map(get, pieces))) for i, pieces in zip(plain, cut, strict=True))
        for piece in new:
            if len(piece) > CACHE_WORD:
                del self.pieces[piece]
        odd = sorted(set(range(len(words))).difference(plain))
        for at in range(0, len(odd), 10_000):
            part = odd[at : at + 10_000]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([texts[i] for i in part], add_special_tokens=False), strict=True):
                self.words[words[i]] = struct.pack(f"<{len(e.ids)}I", *e.ids)

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if len(self.words) > CACHE_WORDS:
            self.words = {}
        words = [t.split() for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self.words))
        if new:
            self._learn(new)
        get = self.words.__getitem__
        out = [b"".join(map(get, ws)) for ws in words]
        for w in new:
            if len(w) > CACHE_WORD:
                del self.words[w]
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """The process's encoder: what one task has learned serves the next one."""
    return WordEncoder(path)


def default_tokenizer() -> str:
    """Path of the lower-casing BPE with 49,408 ids whose words end in a mark of their own."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2) -> str:
    """Encode ``docs`` (``doc_id``, ``text``; further columns are left out) and write packed files in the order of ids.

    Rows are range-partitioned by id and sorted in their ranges; null ids come first, rows that share an
    id are ordered by the hash of their text, and repeated rows are written again. Ids may be of any
    type that can be ordered. An empty table gives a folder with a list of no files. Returns ``path``.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    spark.dataSource.register(PackedIds)
    tokenizer = tokenizer or default_tokenizer()
    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size()
    rows = docs.select("doc_id", "text")
    order = ["doc_id", F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = placed.write.format("packed_ids").option("bits", str(width_of(max(vocabulary, end + 1))))
    writer.option("tokenizer", tokenizer).option("end", str(end)).mode("append").save(path)
    return path


def read_token_files(spark: SparkSession, path: str, binary: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of the documents in a folder of packed files.

    ``ids`` is an array of int, or, if ``binary``, the ids as little-endian unsigned 32-bit numbers.
    """
    spark.dataSource.register(PackedIds)
    return spark.read.format("packed_ids").option("binary", str(binary).lower()).load(path)


def op12_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents as packed ids and read them back."""
    path = write_token_files(read(spark, sf_dir, "documents"), f"{shared_dir(spark).rstrip('/')}/{fresh('tokens')}")
    tokens = read_token_files(spark, path, binary=True)
    return tokens.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
