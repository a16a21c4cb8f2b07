"""Periodic stretches of words, found by suffix trees.

A run is a stretch of words with a smallest period q that goes on for three periods at least and that no neighbouring
word extends. Every run holds a Lyndon word of its period's length that ends where the next smaller suffix begins, in one of the two
orders of words (ascending or descending). So each word gives two candidates, and each is extended in both directions by longest
common extensions: to the right in the suffix tree of the words, to the left in that of the reversal. The trees are Ukkonen's; an
Euler tour of each keeps, between neighbouring leaves, the least depth that it visits, and a sparse table over these
answers the depth of any two leaves' lowest common ancestor in constant time.

All eight-word windows of a run occur twice within it, so trees are built for the stretches of repeated windows only.
A document costs time n log n and memory in proportion to its repeated stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a window; any run of the least length repeats all of its windows of this many words.
WINDOW = 8
#: Documents whose results are held at once.
SLICE = 256
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def suffix_tree(s: list[int], base: int) -> tuple[dict[int, int], list[int], list[int], list[int]]:
    """Ukkonen's tree of ``s``, whose last sign occurs once: children by ``node * base + sign``, the ends of each node's edge, and the leaves by suffix."""
    n = len(s)
    first, stop, link, leaves = [0], [0], [0], []
    child: dict[int, int] = {}
    node = edge = length = left = 0
    for i, sign in enumerate(s):
        left += 1
        last = -1
        while left:
            if not length:
                edge = i
            key = node * base + s[edge]
            below = child.get(key)
            if below is None:
                child[key] = len(first)
                leaves.append(len(first))
                first.append(i)
                stop.append(n)
                link.append(0)
                if last >= 0:
                    link[last] = node
                    last = -1
            else:
                size = stop[below] - first[below]
                if length >= size:
                    edge += size
                    length -= size
                    node = below
                    continue
                at = first[below] + length
                if s[at] == sign:
                    length += 1
                    if last >= 0:
                        link[last] = node
                    break
                fork = len(first)
                first += (first[below], i)
                stop += (at, n)
                link += (0, 0)
                leaves.append(fork + 1)
                child[key] = fork
                child[fork * base + sign] = fork + 1
                first[below] = at
                child[fork * base + s[at]] = below
                if last >= 0:
                    link[last] = fork
                last = fork
            left -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - left + 1
    return child, first, stop, leaves


class Extensions:
    """Longest common extensions of the suffixes of a list of signs that ends with its only 0."""

    def __init__(self, s: list[int], base: int) -> None:
        child, first, stop, leaves = suffix_tree(s, base)
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self._below = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        self._from = np.searchsorted(keys[order], np.arange(len(first) + 1) * base).tolist()
        self._size = [b - a for a, b in zip(first, stop)]
        self._leaves = leaves
        tour, least = self._tour()
        self.rank = np.empty(len(s), np.int64)
        self.rank[tour] = np.arange(len(s))
        table = [np.array(least, np.int32)]
        width = 1
        while 2 * width <= len(s):
            row = table[-1].copy()
            row[:-width] = np.minimum(row[:-width], row[width:])
            table.append(row)
            width *= 2
        self._table = np.stack(table)

    def _tour(self) -> tuple[np.ndarray, list[int]]:
        """The leaves' suffixes in the tour's order, and before each the least depth since the leaf before it."""
        starts, below, size = self._from, self._below, self._size
        seen: list[int] = []
        least: list[int] = []
        todo = [(0, 0, 0)]
        while todo:
            node, depth, low = todo.pop()
            lo, hi = starts[node], starts[node + 1]
            if lo == hi:
                seen.append(node)
                least.append(low)
                continue
            depth += size[node]
            for at in range(hi - 1, lo, -1):
                todo.append((below[at], depth, depth))
            todo.append((below[lo], depth, low))
        suffix = np.empty(len(size), np.int64)
        suffix[self._leaves] = np.arange(len(self._leaves))
        return suffix[seen], least

    def descending_rank(self) -> np.ndarray:
        """Ranks of the suffixes when signs are ordered downwards, but for 0, which stays the least."""
        starts, below = self._from, self._below
        seen: list[int] = []
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = starts[node], starts[node + 1]
            if lo == hi:
                seen.append(node)
                continue
            own = below[lo:hi]
            # the edge of 0 alone comes first among its siblings; no other leaf's edge has one sign
            if starts[own[0]] == starts[own[0] + 1] and self._size[own[0]] == 1:
                todo += own[1:]
                todo.append(own[0])
            else:
                todo += own
        suffix = np.empty(len(self._size), np.int64)
        suffix[self._leaves] = np.arange(len(self._leaves))
        rank = np.empty(len(seen), np.int64)
        rank[suffix[seen]] = np.arange(len(seen))
        return rank

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The length that suffixes ``a`` and ``b`` (different ones) share."""
        ra, rb = self.rank[a], self.rank[b]
        lo, hi = np.minimum(ra, rb) + 1, np.maximum(ra, rb)
        level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
        return np.minimum(self._table[level, lo], self._table[level, hi - (1 << level) + 1])


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """By suffix, the next one of lower rank; the last suffix has none and is left out."""
    ranks = rank.tolist()
    out = [0] * (len(ranks) - 1)
    open_: list[int] = []
    for i, r in enumerate(ranks):
        while open_ and ranks[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of any hashable words, by start, then period."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    known: dict = {}
    ids = [known.setdefault(w, len(known) + 1) for w in words]
    base = len(known) + 1
    ahead = Extensions([*ids, 0], base)
    back = Extensions([*ids[::-1], 0], base)
    found = []
    for rank in (ahead.rank, ahead.descending_rank()):
        i, j = np.arange(n), _next_smaller(rank)
        keep = LEAST_PERIODS * (j - i) <= n
        i, j = i[keep], j[keep]
        right = ahead.common(i, j)  # 0 where j is the end
        left = np.zeros(len(i), np.int64)
        inner = i > 0
        left[inner] = back.common(n - i[inner], n - j[inner])
        start, length, period = i - left, j + right - i + left, j - i
        keep = length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        found.append(np.stack([start[keep], period[keep], length[keep]], 1))
    return [(s, length, p) for s, p, length in np.unique(np.concatenate(found), axis=0).tolist()]


def repeated_stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Stretches (start, end) outside of which no run has a word; hashes that meet by chance only make them longer."""
    n = len(words)
    if n < LEAST_WORDS:
        return []
    x = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for k, factor in enumerate(_FACTORS):
        h += (x[k : n - WINDOW + 1 + k] ^ (x[k : n - WINDOW + 1 + k] >> np.uint64(29))) * factor
    ordered = np.sort(h)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    marked = np.concatenate([[False], np.isin(h, twice), [False]])
    edges = np.flatnonzero(marked[1:] != marked[:-1])
    return [(lo, hi + WINDOW - 1) for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist()) if hi - lo + WINDOW - 1 >= LEAST_WORDS]


def document_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """``runs_of`` a document, of which only the repeated stretches are looked at."""
    out = [(lo + s, length, p) for lo, hi in repeated_stretches(words) for s, length, p in runs_of(words[lo:hi])]
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run has after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, runs array<struct<start, length, period>>, collapsed)`` of each row's whole text.

    Words are split at ASCII white space; starts, lengths and periods count words. ``collapsed`` joins by a space the words that are left when
    each run keeps its first period only. A null or empty text, or one of white space, has no words, no runs and an empty ``collapsed``. Repeated rows and
    null ids are rows like others, a very long text is one task's work (see above), an empty table gives no rows, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                n, runs, texts = [], [], []
                for text in part.column("text").to_pylist():
                    words = (text or "").encode("utf-8", "surrogatepass").split()
                    own = document_runs(words)
                    n.append(len(words))
                    runs.append([{"start": s, "length": length, "period": p} for s, length, p in own])
                    texts.append(b" ".join(collapse(words, own)).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` in which a tenth of the documents, by the checksum of the id, repeats its words from some word on; a null id or text changes nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    planted = planted.withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("words")}).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END"))
    planted = planted.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    cycle = F.expr("array_join(transform(sequence(0L, n - 1L), i -> words[CAST(IF(i < a, i, a + (i - a) % p) AS INT)]), ' ')")
    return planted.select("doc_id", F.when(F.col("h").isNotNull() & (F.col("h") % 10 == 0) & (F.col("n") > 0), cycle).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)`` of documents with planted runs.

    The run told is that of the greatest length over period (ties: least start, then period); without a run its columns are null.
    """
    by: Column = F.expr(
        "array_sort(runs, (x, y) -> CASE WHEN x.length * y.period <> y.length * x.period THEN IF(x.length * y.period > y.length * x.period, -1, 1) "
        "WHEN x.start <> y.start THEN IF(x.start < y.start, -1, 1) WHEN x.period <> y.period THEN IF(x.period < y.period, -1, 1) ELSE 0 END)[0]"
    )
    written = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = periodic_runs(with_planted_runs(docs)).withColumn("best", F.when(F.size("runs") > 0, by))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(written, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_CRC = """
crc(s, k, c) AS (SELECT DISTINCT CAST(doc_id AS VARCHAR), 0, 4294967295::BIGINT FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT s, k + 1, xor(x >> 1, 3988292384 * (x & 1)) FROM (SELECT s, k, CASE WHEN k % 8 = 0 THEN xor(c, ascii(substr(s, k // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM crc WHERE k < 8 * len(s)))
"""
RUNS_SQL = rf"""
WITH RECURSIVE {_CRC},
d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
h AS (SELECT row, doc_id, ws, len(ws) AS n, xor(c, 4294967295) AS h, xor(c, 4294967295) // 10 AS g FROM d LEFT JOIN crc ON crc.s = CAST(d.doc_id AS VARCHAR) AND crc.k = 8 * len(crc.s)),
m AS (SELECT row, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN [ws[CASE WHEN i < g % n THEN i ELSE g % n + (i - g % n) % (1 + (n - g % n) // (3 + g % 8)) END + 1] FOR i IN range(0, n)] ELSE ws END AS ws FROM h),
p AS (SELECT row, n, unnest(range(0, n)) AS i, unnest(ws) AS w FROM m),
e AS (SELECT x.row, x.i, y.i - x.i AS q FROM p x JOIN p y ON x.row = y.row AND x.w = y.w AND y.i > x.i AND 3 * (y.i - x.i) <= x.n WHERE x.n >= 24),
s AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT row, q, i, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM e) GROUP BY row, q, island HAVING count(*) + q >= greatest(24, 3 * q)),
r AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.row = s.row AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
best AS (SELECT row, start, length, q FROM r QUALIFY row_number() OVER (PARTITION BY row ORDER BY CAST(length AS HUGEINT) * 1000000000000 // q DESC, start, q) = 1),
told AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS runs FROM r GROUP BY row),
gone AS (SELECT DISTINCT row, unnest(range(start + q, start + length)) AS i FROM r),
kept AS (SELECT row, string_agg(w, ' ' ORDER BY i) AS t FROM p ANTI JOIN gone USING (row, i) GROUP BY row)
SELECT m.doc_id, coalesce(n_runs, 0) AS n_runs, best.start, best.length, best.q AS period, 1000 * best.length // best.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM m LEFT JOIN best USING (row) LEFT JOIN told USING (row) LEFT JOIN kept USING (row)
"""
