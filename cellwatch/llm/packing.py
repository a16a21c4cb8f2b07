"""Documents packed into as few sequences of fixed capacity as possible.

The linear program over configurations (multisets of lengths that fit a sequence) asks for the least number of configurations that cover
the histogram of lengths. Multiplicative weights solve it: each round prices lengths by their size times a weight that falls
as a length's demand is met, a knapsack by dynamic programming over the capacity gives the best completion of every length at once, and the
best configurations take steps. The solution is rounded down, then up where demand allows, and what is left is put by best fit
into the spaces of the chosen configurations and new sequences.

The program sees the histogram only, so what reaches the driver and is sent back is bounded by the capacity, ROUNDS and SEEDS, not by the
data. Spark encodes each text once, numbers the pieces of each length by counts of (length, partition), and each piece looks its place up by
its length and number.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer

from cellwatch.llm.bpe import _added
from cellwatch.llm.scratch import Scratch

#: The id that ends every document.
END_ID = 0
#: Rounds of weights, configurations that take a step in a round, the largest share of a demand that a step meets, and how fast weights fall.
ROUNDS, SEEDS, STEP, RATE = 300, 256, 0.5, 0.1
#: Long pieces are worth more for their size by up to this much, so that short ones are left to fill the last spaces.
LONG_FIRST = 0.1
#: Pre-tokens that a worker keeps for sure (up to twice as many in all), and the longest that it keeps.
CACHE, CACHE_CHARS = 400_000, 48
#: Documents whose ids are held at once.
SLICE = 128


# --- ids

def _byte_signs() -> dict[int, int]:
    """The sign that byte-level vocabularies write for each byte: itself where it is printable Latin-1, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(odd)}


class _Known(dict):
    """Packed ids by pre-token; one that is missing comes from the generation before, or from the tokenizer."""

    def __init__(self, tokenize, signs: dict[int, int], older: dict[str, bytes]) -> None:
        self.tokenize, self.signs, self.older = tokenize, signs, older

    def __missing__(self, token: str) -> bytes:
        ids = self.older.get(token)
        if ids is None:
            ids = np.array([x.id for x in self.tokenize(token.encode().decode("latin-1").translate(self.signs))], "<u4").tobytes()
        if len(token) <= CACHE_CHARS:
            self[token] = ids
        return ids


class Ids:
    """Ids of whole texts by a byte-level tokenizer file; pre-tokens that a worker has seen lately are not encoded again."""

    def __init__(self, path: str, pattern: str) -> None:
        tokenizer = Tokenizer.from_file(path)
        if type(tokenizer.pre_tokenizer).__name__ != "ByteLevel" or tokenizer.normalizer is not None:
            raise ValueError("a byte-level tokenizer without normalizer is needed")
        self.tokenizer, self.split, self.signs = tokenizer, regex.compile(pattern).findall, _byte_signs()
        self.known = _Known(tokenizer.model.tokenize, self.signs, {})

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if len(self.known) >= CACHE:
            self.known.older.clear()
            self.known = _Known(self.known.tokenize, self.signs, self.known)
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), "<u4")


_coders: dict[tuple[str, str], Ids] = {}


def _coder(name: str, pattern: str) -> Ids:
    if (name, pattern) not in _coders:
        _coders[name, pattern] = Ids(SparkFiles.get(name), pattern)
    return _coders[name, pattern]


def token_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int, with_ids: bool = False) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, part, at)``, ``with_ids`` also ``ids binary``: each whole text's ids and END_ID, cut where they exceed the capacity.

    All pieces but the first have the whole capacity. ``ids`` are little-endian unsigned 32-bit numbers. ``at`` numbers the pieces of one length within the
    partition ``part``. A null or empty text is END_ID alone; repeated rows and null ids are rows like others; other columns are ignored.
    """
    name = _added(docs.sparkSession, tokenizer_path)
    end = np.uint32(END_ID).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen, part = _coder(name, pattern), Counter(), TaskContext.get().partitionId()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                rows = batch.slice(lo, SLICE)
                source, piece, start, length, check, out, at = [], [], [], [], [], [], []
                for row, text in enumerate(rows.column("text").to_pylist()):
                    ids = coder.packed(text or "") + end
                    n = len(ids) // 4
                    for k, stop in enumerate(range((n - 1) % capacity + 1, n + 1, capacity)):
                        begin = 0 if k == 0 else stop - capacity
                        packed = ids[4 * begin : 4 * stop]
                        source.append(row)
                        piece.append(k)
                        start.append(begin)
                        length.append(stop - begin)
                        check.append(zlib.crc32(packed))
                        if with_ids:
                            out.append(packed)
                        at.append(seen[stop - begin])
                        seen[stop - begin] += 1
                columns = [rows.column("doc_id").take(pa.array(source, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, check))]
                columns += [pa.array([part] * len(at), pa.int32()), pa.array(at, pa.int64())] + [pa.array(out, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "at"] + ["ids"] * with_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, at bigint" + ", ids binary" * with_ids)


# --- the program

def knapsack(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By capacity, the best total value of any multiset of lengths that fits, and a length to take first (0: leave one unit free)."""
    best, take = np.zeros(len(value)), np.zeros(len(value), np.int64)
    for c in range(1, len(value)):
        total = best[c - 1 :: -1][:c] + value[1 : c + 1]
        k = int(total.argmax())
        if total[k] > best[c - 1]:
            best[c], take[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, take


def _filled(take: np.ndarray, c: int) -> Counter:
    out: Counter = Counter()
    while c > 0:
        length = int(take[c])
        out[length] += length > 0
        c -= max(length, 1)
    del out[0]
    return out


def fractional_cover(demand: np.ndarray) -> dict[tuple[tuple[int, int], ...], float]:
    """Configurations (pairs of length and number) and how often each is used; together they use no more than the demand, and all but a little of it."""
    capacity = len(demand) - 1
    need, sizes = demand.astype(float), np.arange(len(demand), dtype=float)
    rest, volume, used = need.copy(), need * sizes, {}
    for _ in range(ROUNDS):
        open_ = rest > 1e-6 * np.maximum(need, 1)
        open_[0] = False
        if not open_.any():
            break
        met = 1 - rest / np.maximum(need, 1)
        weight = np.exp(-RATE * (met - (met * volume).sum() / volume.sum()))
        value = np.where(open_, sizes * (1 + LONG_FIRST * sizes / capacity) * weight, 0.0)
        best, take = knapsack(value)
        short_of = np.where(open_, best[capacity] - value - best[::-1], np.inf)
        for length in np.argsort(short_of, kind="stable")[:SEEDS].tolist():
            if not open_[length]:
                break
            config = _filled(take, capacity - length)
            config[length] += 1
            step = min(min(rest[k], STEP * need[k]) / m for k, m in config.items())
            if step > 1e-9:
                key = tuple(sorted(config.items()))
                used[key] = used.get(key, 0.0) + step
                for k, m in key:
                    rest[k] -= step * m
    return used


def best_fit(demand: np.ndarray, started: list[tuple[int, dict[int, int]]]) -> list[tuple[int, dict[int, int]]]:
    """Pieces by falling length, each into the fullest sequence that takes it; equal sequences are handled together, ``started`` ones first filled up."""
    capacity = len(demand) - 1
    by_space: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(capacity + 1)]
    for n, config in started:
        by_space[capacity - sum(k * m for k, m in config.items())].append((n, config))
    for length in range(capacity, 0, -1):
        left, space = int(demand[length]), length
        while left:
            while space <= capacity and not by_space[space]:
                space += 1
            if space > capacity:
                full, rest = divmod(left, capacity // length)
                for n, m in ((full, capacity // length), (1, rest)):
                    if n and m:
                        by_space[capacity - m * length].append((n, {length: m}))
                break
            n, config = by_space[space].pop()
            taken = min(n, left)
            left -= taken
            if n > taken:
                by_space[space].append((n - taken, config))
            by_space[space - length].append((taken, config | {length: config.get(length, 0) + 1}))
            space = max(length, min(space, space - length))
    return [x for group in by_space for x in group]


def plan_sequences(demand: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """``(number of sequences, {length: pieces in each})`` that hold exactly ``demand[length]`` pieces of each length up to ``len(demand) - 1``."""
    used, left = fractional_cover(demand), demand.astype(np.int64).copy()
    whole: Counter = Counter()

    def take(config: tuple[tuple[int, int], ...], n: int) -> None:
        whole[config] += n
        for k, m in config:
            left[k] -= n * m

    for config, x in used.items():
        if n := min(int(x + 1e-9), *(int(left[k]) // m for k, m in config)):
            take(config, n)
    for config in sorted(used, key=lambda c: (int(used[c] + 1e-9) - used[c], c)):  # the largest fractions go up first
        if all(left[k] >= m for k, m in config):
            take(config, 1)
    return best_fit(left, [(n, dict(config)) for config, n in whole.items()])


class Places:
    """Where the n-th piece of a length goes."""

    def __init__(self, plan: list[tuple[int, dict[int, int]]]) -> None:
        rows, taken, sequence = [], Counter(), 0
        for n, config in plan:
            offset = 0
            for length, m in sorted(config.items(), reverse=True):
                rows.append((length, taken[length], sequence, m, offset))
                taken[length] += n * m
                offset += length * m
            sequence += n
        rows.sort()
        self.length, self.first, self.sequence, self.each, self.offset = np.array(rows, np.int64).reshape(-1, 5).T.copy()

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(sequence, offset)`` of pieces by length and number."""
        row = np.empty(len(length), np.int64)
        for own in np.unique(length):
            lo, hi = np.searchsorted(self.length, [own, own + 1])
            at = length == own
            row[at] = lo + np.searchsorted(self.first[lo:hi], number[at], "right") - 1
        number = number - self.first[row]
        return self.sequence[row] + number // self.each[row], self.offset[row] + number % self.each[row] * length


def place(pieces: DataFrame, capacity: int, scratch: Scratch) -> DataFrame:
    """``pieces``, a written table with ``(length, part, at)``, and each one's ``sequence_id`` and ``offset``; no two pieces of one length and part share ``at``.

    Lengths are between 1 and the capacity. A length that many rows share is no hot group: its rows are numbered by counts of each part.
    """
    counts = scratch.save(pieces.groupBy("length", "part").count(), "counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # a row for each length
        histogram[row["length"]] = row["n"]
    places, columns = Places(plan_sequences(histogram)), pieces.columns
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.join(counts.select("length", "part", before.alias("before")), ["length", "part"]).withColumn("number", F.expr("before + at")).drop("before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sequence, offset = places.find(batch.column("length").to_numpy(), batch.column("number").to_numpy())
                kept = [batch.column(c) for c in columns]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return numbered.select(*columns, "number").mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def packed_pieces(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece of every row of ``docs``; see ``token_pieces`` for odd rows.

    A sequence's pieces follow each other from offset 0 on without gaps. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(token_pieces(docs, tokenizer_path, pattern, capacity), "pieces")
    return place(pieces, capacity, scratch).drop("part", "at")


def packed_sequences(docs: DataFrame, tokenizer_path: str, pattern: str, capacity: int = 2048) -> DataFrame:
    """``(sequence_id, ids array<int>)``: the sequences themselves. A sequence gathers at most ``capacity`` ids, so no group is unbounded."""
    scratch = Scratch(docs.sparkSession, "packing")
    placed = place(scratch.save(token_pieces(docs, tokenizer_path, pattern, capacity, with_ids=True).select("length", "part", "at", "ids"), "pieces"), capacity, scratch)
    whole = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in own), "<u4").astype(np.int32) for own in batch.column("own").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return whole.mapInArrow(run, "sequence_id bigint, ids array<int>")
