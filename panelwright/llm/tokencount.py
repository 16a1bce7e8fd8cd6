"""Token counts by a linear longest-match automaton.

Word-piece tokenisers take the longest vocabulary entry at each place of a word. The automaton
is the vocabulary's trie in which every node knows where a match goes on when the next byte
does not fit: the failure link leads to the node of what is left of the path after as many
longest pieces as possible are popped from its front, and the node holds how many those are
(Song et al., 2021). A word is read once, byte by byte, and the counts popped on the way add up
to its number of pieces, none of which is ever built.
"""

from __future__ import annotations

import base64
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, read, schema_of, utf8, without

#: Distinct words whose counts a worker remembers, and the bytes up to which one is remembered.
REMEMBERED, LONGEST_KEPT = 500_000, 64


def default_vocabulary() -> str:
    """Path of a vocabulary of byte strings, one base64 entry and its rank a line."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def load_vocabulary(path: str) -> list[bytes]:
    """The entries of a vocabulary file."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """Counts of greedy longest-match pieces.

    With a ``continuation`` mark, such as ``##``, entries that begin with it match only after
    another piece and the others only at a word's start; without one all match anywhere.
    """

    def __init__(self, vocabulary: list[bytes], continuation: bytes = b""):
        self.rest = 1 if continuation else 0  # root of what follows a piece
        self.next: list[dict[int, int]] = [{} for _ in range(self.rest + 1)]
        entry = [False] * len(self.next)
        for piece in vocabulary:
            node = 0
            if continuation and piece.startswith(continuation):
                node, piece = self.rest, piece.removeprefix(continuation)
            for byte in piece:
                to = self.next[node].get(byte)
                if to is None:
                    to = len(self.next)
                    self.next[node][byte] = to
                    self.next.append({})
                    entry.append(False)
                node = to
            entry[node] = entry[node] or bool(piece)
        self.link: list[int] = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        queue = deque(range(self.rest + 1))
        while queue:
            node = queue.popleft()
            for byte, to in self.next[node].items():
                queue.append(to)
                if entry[to]:
                    self.link[to], self.popped[to] = self.rest, 1
                    continue
                back, count = self.link[node], self.popped[node]
                while back >= 0 and byte not in self.next[back]:
                    count += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[to], self.popped[to] = self.next[back][byte], count

    def count(self, word: bytes) -> int:
        """Pieces of a word; 1, the unknown piece, if it can't be cut into entries."""
        node, total, step, link, popped = 0, 0, self.next, self.link, self.popped
        for byte in word:
            while (to := step[node].get(byte)) is None:
                total += popped[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node > self.rest:
            total += popped[node]
            node = link[node]
            if node < 0:
                return 1
        return total


def token_counts(docs: DataFrame, vocabulary: str | None = None, mark: bytes = b" ", continuation: bytes = b"") -> DataFrame:
    """``docs`` (any columns; ``text``) with ``n_words`` and ``n_tokens``.

    A word is marked at its start, as vocabularies with marked word starts need; ``mark`` may be
    empty. Vocabularies that mark continued pieces instead name that mark in ``continuation``. Null and empty texts have none of either. Each row counts, repeated or not.
    """
    path = vocabulary or default_vocabulary()
    base = without(docs, "n_words", "n_tokens")

    def make():
        machine = LongestMatch(load_vocabulary(path), continuation)

        class Known(dict):
            def __missing__(self, word: bytes) -> int:
                n = machine.count(mark + word)
                if len(word) <= LONGEST_KEPT:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[word] = n
                return n

        known = Known()

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = [t.split() for t in utf8(batch.column("text"))]
            counts = [sum(map(known.__getitem__, w)) for w in words]
            arrays = [pa.array(list(map(len, words)), type=pa.int64()), pa.array(counts, type=pa.int64())]
            return pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, "n_words", "n_tokens"])

        return f

    return map_texts(base, make, schema_of(base, "n_words long, n_tokens long"))


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy pieces of every document."""
    out = token_counts(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_tokens", F.try_divide("n_tokens", "n_words").alias("tokens_per_word"))
