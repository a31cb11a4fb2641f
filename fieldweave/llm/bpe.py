"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its byte (or nothing); an
inner node holds the leftmost smallest rank below it. Each merge reads the root
and updates two leaves, the merged part and its live left neighbour, so a piece
of n bytes takes O(n log n) steps however long it is. Pieces are the matches of
the pre-tokenization pattern; common short pieces are remembered by a worker.

Null and empty texts give no ids, empty tables no rows. Rows are handled one by one, so repeated rows
give repeated results, and no other column is read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from fieldweave.llm.common import per_row

#: A worker remembers so many pieces of at most so many bytes.
REMEMBERED_PIECES, SHORT = 300_000, 48


def read_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: base64 of a token's bytes and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, content.splitlines())))}


def load_ranks(path: str) -> dict[bytes, int]:
    return read_ranks(Path(path).read_bytes())


class PairTree:
    """Leftmost minimum over the ranks of neighbouring parts."""

    def __init__(self, leaves: list[int], none: int) -> None:
        self.none, size = none, 1
        while size < len(leaves):
            size *= 2
        self.size = size
        tree = [none] * size + leaves + [none] * (size - len(leaves))
        for node in range(size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left <= right else right
        self.tree = tree

    def set(self, leaf: int, rank: int) -> None:
        tree, node = self.tree, leaf + self.size
        tree[node] = rank
        while node > 1:
            node //= 2
            left, right = tree[2 * node], tree[2 * node + 1]
            low = left if left <= right else right
            if tree[node] == low:
                break
            tree[node] = low

    def leftmost(self) -> int:
        """The leaf that holds the smallest rank, the leftmost of several; -1 if there is none."""
        tree, low, node = self.tree, self.tree[1], 1
        if low == self.none:
            return -1
        while node < self.size:
            node = 2 * node if tree[2 * node] == low else 2 * node + 1
        return node - self.size


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the leftmost pair of least rank merges until none is left."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, none = len(piece), len(ranks) + 1_000_000_000
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    find = ranks.get
    tree = PairTree([find(piece[i : i + 2], none) if i + 2 <= n else none for i in range(n)], none)
    while (at := tree.leftmost()) >= 0:
        gone = after[at]
        beyond = after[gone]
        after[at] = beyond
        if beyond < n:
            before[beyond] = at
        tree.set(gone, none)
        tree.set(at, find(piece[at : after[beyond]], none) if beyond < n else none)
        left = before[at]
        if left >= 0:
            tree.set(left, find(piece[left:beyond], none))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : after[at]]])
        at = after[at]
    return out


class Codec(dict):
    """Piece to ids; remembers short pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        super().__init__()
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.digits_of = {rank: str(rank) for rank in self.ranks.values()}

    def __missing__(self, piece: str) -> list[int]:
        ids = encode_piece(piece.encode(), self.ranks)
        if len(piece) <= SHORT:
            self[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if len(self) > REMEMBERED_PIECES:
            self.clear()
        return list(chain.from_iterable(map(self.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codecs(spark: SparkSession, path: str, pattern: str) -> Callable[[], Codec]:
    """Gives a worker its codec, set up once for a vocabulary and kept from task to task.

    The driver reads the rank file and broadcasts it: it is as large as the vocabulary, whatever the texts.
    """
    content = Path(path).read_bytes()
    key, held = (hashlib.sha256(content).hexdigest(), pattern), spark.sparkContext.broadcast(content)

    def codec() -> Codec:
        if key not in _CODECS:
            _CODECS.clear()
            _CODECS[key] = Codec(read_ranks(held.value), pattern)
        return _CODECS[key]

    return codec


def encode(docs: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every text; null text: no ids."""
    codec = codecs(docs.sparkSession, path, pattern)

    def make():
        tool = codec()

        def work(batch: pa.RecordBatch) -> dict:
            return {doc_id: batch.column(0), "ids": [tool.encode(x or "") for x in batch.column(1).to_pylist()]}

        return work

    return per_row(docs, [doc_id, text], f"`{doc_id}` {docs.schema[doc_id].dataType.simpleString()}, ids array<int>", make)


def decode(encoded: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text binary): the bytes that the ids stand for; null ids: empty."""
    codec = codecs(encoded.sparkSession, path, pattern)

    def make():
        tool = codec()

        def work(batch: pa.RecordBatch) -> dict:
            return {doc_id: batch.column(0), "text": [tool.decode(x or []) for x in batch.column(1).to_pylist()]}

        return work

    return per_row(encoded, [doc_id, ids], f"`{doc_id}` {encoded.schema[doc_id].dataType.simpleString()}, text binary", make)


def round_trip(docs: DataFrame, path: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each text, decode its ids, and keep lengths and digests of both.

    (doc_id, n_tokens, ids_sha256, decoded_sha256): the digests are lowercase
    hex of the ids in decimal joined by commas, and of the decoded bytes.
    """
    codec = codecs(docs.sparkSession, path, pattern)

    def make():
        tool = codec()

        def work(batch: pa.RecordBatch) -> dict:
            counts, id_digests, byte_digests = [], [], []
            for value in batch.column(1).to_pylist():
                ids = tool.encode(value or "")
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(",".join(map(tool.digits_of.__getitem__, ids)).encode()).hexdigest())
                byte_digests.append(hashlib.sha256(tool.decode(ids)).hexdigest())
            return {doc_id: batch.column(0), "n_tokens": counts, "ids_sha256": id_digests, "decoded_sha256": byte_digests}

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    return per_row(docs, [doc_id, text], f"`{doc_id}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
