"""Byte-level BPE with a hierarchical-bitmap rank queue.

Merge candidates wait in buckets, one for each merge rank, which hold positions of a linked list of parts. A
three-level bitmap marks the buckets in use; find-first-set on the levels gives the least rank in constant time, and
its bucket is worked off from left to right. An entry whose part has been merged since, or whose right neighbour has changed, is stale and
skipped. Pre-tokens never merge with each other, so all new pre-tokens of a batch of texts lie in one linked list and
share one queue. A pre-token of n bytes takes O(n log n) steps, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bits in a word of the bitmap's lower levels.
WORD = 64
#: Encoded pre-tokens that a worker keeps for sure (up to twice as many in all), and the longest that it keeps.
CACHE = 150_000
CACHE_CHARS = 48
#: Characters of texts that are encoded together, but for a longer text, which goes alone; bounds memory.
BATCH_CHARS = 1 << 18
#: Bytes of pre-tokens in one linked list, but for a longer pre-token, which has one for itself.
LIST_BYTES = 1 << 14
#: In the list of parts: the end of a pre-token, and a part that was merged into its left neighbour. A byte b without an id is -1 - b.
_END, _GONE = -300, -301


class RankQueue:
    """Positions by rank; ``pop`` takes the bucket of the least rank."""

    __slots__ = ("top", "mid", "low", "buckets")

    def __init__(self, n_ranks: int) -> None:
        words = -(-n_ranks // WORD)
        self.low = [0] * words
        self.mid = [0] * -(-words // WORD)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def open(self, rank: int, positions: list[int]) -> None:
        """A bucket for a rank that has none."""
        self.buckets[rank] = positions
        w = rank >> 6
        m = w >> 6
        self.low[w] |= 1 << (rank & 63)
        self.mid[m] |= 1 << (w & 63)
        self.top |= 1 << m

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.open(rank, [at])
        else:
            bucket.append(at)

    def pop(self) -> tuple[int, list[int]] | None:
        """The least rank and its positions, from left to right."""
        top = self.top
        if not top:
            return None
        m = (top & -top).bit_length() - 1
        x = self.mid[m]
        w = (m << 6) + (x & -x).bit_length() - 1
        y = self.low[w]
        rank = (w << 6) + (y & -y).bit_length() - 1
        y &= y - 1
        self.low[w] = y
        if not y:
            x &= x - 1
            self.mid[m] = x
            if not x:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


class Coder:
    """Encodes text to the ids of a rank file, and ids back to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.vocabulary = {i: b for b, i in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.bytes = np.array([ranks.get(bytes([b]), -1 - b) for b in range(256)], np.int32)
        numbered = ranks | {bytes([b]): int(i) for b, i in enumerate(self.bytes)}
        #: By a part's id (negative ones from the end): the ranks of its pairs with right neighbours, by their ids.
        self.right_of: list[dict[int, int]] = [{} for _ in range(max(ranks.values(), default=0) + 1 - _GONE)]
        for t, i in ranks.items():
            for k in range(1, len(t)):
                if t[:k] in numbered and t[k:] in numbered:
                    self.right_of[numbered[t[:k]]][numbered[t[k:]]] = i
        #: The rank of two adjacent bytes, -1 if they don't merge.
        self.of_bytes = np.array([[self.right_of[a].get(b, -1) for b in self.bytes.tolist()] for a in self.bytes.tolist()], np.int32)
        self.digits = {i: str(i) for i in ranks.values()}
        # ids of pre-tokens, packed: bytes are nothing to Python's garbage collector, which would walk over tuples
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pre-tokens that are no single token; one linked list holds all of them."""
        text = np.frombuffer(b"\0".join(pieces) + b"\0", np.uint8)
        ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
        n = len(text)
        first = self.bytes[text]
        first[ends] = _END
        ranks = np.append(self.of_bytes[text[:-1], text[1:]], np.int32(-1))
        ranks[ends] = -1
        ranks[ends - 1] = -1
        parts, due = first.tolist(), ranks.tolist()  # due: the rank of each part's pair with its right neighbour
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue, right_of = self.queue, self.right_of
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0) :]
        cut = np.flatnonzero(np.diff(ranks[order], prepend=-1)).tolist()
        positions = order.tolist()
        for lo, hi in zip(cut, [*cut[1:], len(positions)]):
            queue.open(due[positions[lo]], positions[lo:hi])
        push, pop, bucket_of = queue.push, queue.pop, queue.buckets.get
        while (item := pop()) is not None:
            rank, bucket = item
            right_rank = right_of[rank].get
            for at, i in enumerate(bucket):
                if due[i] != rank:
                    continue  # stale
                j = after[i]
                k = after[j]
                parts[i] = rank
                parts[j] = _GONE
                due[j] = -1
                after[i] = k
                before[k] = i
                due[i] = lower = right_rank(parts[k], -1)
                if lower >= 0:
                    if (more := bucket_of(lower)) is not None:
                        more.append(i)
                    else:
                        push(lower, i)
                h = before[i]
                if h >= 0:
                    left = right_of[parts[h]].get(rank, -1)
                    if left != due[h]:
                        due[h] = left
                        if left >= 0:
                            if (more := bucket_of(left)) is not None:
                                more.append(h)
                            else:
                                push(left, h)
                            if left < rank:
                                lower = left
                if 0 <= lower < rank:  # it goes first
                    for rest in bucket[at + 1 :]:
                        push(rank, rest)
                    break
        ids = np.array(parts, np.int32)
        alive = ids > _END
        if (ids[alive] < 0).any():
            raise KeyError("a byte without an id")
        packed = ids[alive].tobytes()
        stops = (np.cumsum(alive)[ends] * 4).tolist()
        return [packed[lo:hi] for lo, hi in zip([0, *stops], stops)]

    def encode_all(self, texts: list[str]) -> Iterator[array]:
        """All ids of each text; each match of the pattern is merged on its own."""
        group: list[str] = []
        size = 0
        for text in texts:
            if group and size + len(text) > BATCH_CHARS:
                yield from self._encode(group)
                group, size = [], 0
            group.append(text)
            size += len(text)
        if group:
            yield from self._encode(group)

    def _encode(self, texts: list[str]) -> Iterator[array]:
        found = [self.split(t) for t in texts]
        kept, older, ranks = self.kept, self.older, self.ranks
        known: dict[str, bytes] = {}
        new: list[str] = []
        pieces: list[bytes] = []

        def add() -> None:
            for token, ids in zip(new, self.merge(pieces)):
                known[token] = ids
                if len(token) <= CACHE_CHARS:
                    kept[token] = ids
            new.clear()
            pieces.clear()

        size = 0
        for token in set().union(*found):
            ids = kept.get(token)
            if ids is None:
                ids = older.get(token)
                if ids is None:
                    piece = token.encode("utf-8", "surrogatepass")
                    if piece not in ranks:
                        if new and size + len(piece) > LIST_BYTES:
                            add()
                            size = 0
                        new.append(token)
                        pieces.append(piece)
                        size += len(piece)
                        continue
                    ids = array("i", (ranks[piece],)).tobytes()
                kept[token] = ids
            known[token] = ids
        if new:
            add()
        for tokens in found:
            ids = array("i")
            ids.frombytes(b"".join(map(known.__getitem__, tokens)))
            yield ids
        if len(kept) >= CACHE:
            self.kept, self.older = {}, kept

    def encode(self, text: str) -> list[int]:
        """All ids of a text."""
        return next(self.encode_all([text])).tolist()

    def written(self, ids: Iterable[int]) -> str:
        """The decimal ids, joined by a space."""
        return " ".join(map(self.digits.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


_coders: dict[tuple[str, str], Coder] = {}


def _coder(name: str, pattern: str) -> Coder:
    """One coder for each worker process, so its cache lasts over tasks."""
    if (name, pattern) not in _coders:
        with open(SparkFiles.get(name), "rb") as f:
            _coders[name, pattern] = Coder(read_ranks(f), pattern)
    return _coders[name, pattern]


def _added(spark: SparkSession, path: str) -> str:
    """Ship the rank file to every executor; its name there."""
    spark.sparkContext.addFile(path)
    return path.rstrip("/").rpartition("/")[2]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids array<int>, n_tokens, decodes)`` of each row's whole text; ``decodes``: the ids decode to the text's bytes.

    A null or empty text has no ids. Repeated rows and null ids are kept as rows; other columns are ignored. A text is encoded whole whatever its length, in
    time n log n and memory in proportion to it; an empty table gives no rows.
    """
    name = _added(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # bounds the memory of one batch's ids
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = list(coder.encode_all(texts))
                same = [coder.decode(i) == t.encode("utf-8", "surrogatepass") for i, t in zip(ids, texts)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array(map(len, ids), pa.int64()), pa.array(same, pa.bool_())], ["doc_id", "ids", "n_tokens", "decodes"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint, decodes boolean")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, bytes binary)`` of rows ``(doc_id, ids)``; null ids decode to no bytes, an unknown id is an error."""
    name = _added(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _coder(name, pattern).decode
        for batch in batches:
            out = [decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: each whole text encoded, and its ids decoded again, in one pass."""
    name = _added(docs.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(name, pattern)
        for batch in batches:
            n, ids_hash, bytes_hash = [], [], []
            for ids in coder.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(coder.written(ids).encode()).hexdigest())
                bytes_hash.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(bytes_hash, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
