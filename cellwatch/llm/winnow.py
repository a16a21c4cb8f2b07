"""Benchmark decontamination by winnowing.

A window is ``WINDOW`` consecutive words of an item. Document and item are both winnowed: of the hashes of
``GRAM`` consecutive words, the least (rightmost on ties) in every run of ``WINDOW - GRAM + 1`` is kept. Two texts
that share a whole window share the hashes of that run and so the least of them, so the join of fingerprints
misses no shared window. Each joined pair of places is extended word by word, as far as a window around it can reach;
where that makes a window, its words are marked. All windows of a longer shared span are found, each by its own fingerprint, so all of the span
is marked. Items shorter than a window are one window of their own length; their only fingerprint is the hash of all their words.

Executors first drop document fingerprints that hit no set bit of a bitmap of the item fingerprints, whose size follows from their number. What is
joined are hashes of places and of the ``REACH`` words on either side, never texts, so a phrase that very many documents and items share costs
its pairs and nothing more. Words and grams are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from cellwatch.llm.scratch import Scratch

WINDOW = 10
#: Long enough that a common phrase is no fingerprint.
GRAM = 8
#: Words on either side of a gram that a window around it can hold.
REACH = WINDOW - GRAM
#: The bitmap has 16 bits or more for each fingerprint, and so many as a power of two at least and at most (32 MB).
LEAST_BITS, MOST_BITS = 16, 28
WORD_CACHE = 200_000
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: ASCII letters lower-cased; other ASCII characters than letters and digits part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))


def gram_hashes(w: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words."""
    if len(w) < n:
        return np.empty(0, np.uint64)
    last = len(w) - n + 1
    h = w[:last] + np.uint64(n)
    for j in range(1, n):
        h *= _STEP
        h += w[j : last + j]
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def winnowed(h: np.ndarray, run: int) -> np.ndarray:
    """Places of the least hash, the rightmost on ties, in every ``run`` consecutive hashes."""
    if len(h) < run:
        return np.empty(0, np.int64)
    wide = np.lib.stride_tricks.sliding_window_view(h[::-1], run)
    at = len(h) - 1 - (np.argmin(wide, axis=1) + np.arange(len(wide)))
    return np.unique(at)


def neighbours(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each place the hashes of the ``REACH`` words before its gram, nearest first, and behind it; 0 beyond the text's ends."""
    wide = np.concatenate([np.zeros(REACH, np.uint64), w, np.zeros(REACH, np.uint64)])
    steps = [-1 - k for k in range(REACH)] + [GRAM + k for k in range(REACH)]
    return wide[at[:, None] + (REACH + np.array(steps))].view(np.int64)


def fingerprints(w: np.ndarray, short: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document: hashes, places and lengths of its winnowed grams and of every gram as long as a short item."""
    h = gram_hashes(w, GRAM)
    at = winnowed(h, WINDOW - GRAM + 1)
    hashes, places, sizes = [h[at]], [at], [np.full(len(at), WINDOW)]
    for n in short:
        hashes.append(_short(gram_hashes(w, n), n))
        places.append(np.arange(len(hashes[-1])))
        sizes.append(np.full(len(hashes[-1]), n))
    return np.concatenate(hashes), np.concatenate(places), np.concatenate(sizes)


def _short(h: np.ndarray, n: int) -> np.ndarray:
    """Keeps the fingerprints of short items apart from winnowed ones."""
    return h ^ np.uint64(0xA5A5A5A5 + n)


_PRINTS = [("fp", pa.int64()), ("at", pa.int32()), ("size", pa.int32()), *((f"w{k}", pa.int64()) for k in range(2 * REACH))]


def _print_columns(w: np.ndarray, h: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    near = np.zeros((len(at), 2 * REACH), np.int64)
    whole = size == WINDOW
    near[whole] = neighbours(w, at[whole])
    return [h.view(np.int64), at.astype(np.int32), size.astype(np.int32), *near.T]


def _joined(rows: list[list[np.ndarray]]) -> list[pa.Array]:
    return [pa.array(np.concatenate([r[k] for r in rows]) if rows else np.empty(0), kind) for k, (_, kind) in enumerate(_PRINTS)]


def _of_items(batches):
    for batch in batches:
        key, rows = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            w = word_hashes(words(text))
            h, at, size = fingerprints(w, [len(w)] if 0 < len(w) < WINDOW else [])
            key.extend([i] * len(h))
            rows.append(_print_columns(w, h, at, size))
        yield pa.RecordBatch.from_arrays([batch.column("item_key").take(pa.array(key, pa.int64())), *_joined(rows)], ["item_key", *(name for name, _ in _PRINTS)])


def _of_documents(bitmap, bits: int, short: list[int]):
    def run(batches):
        set_bits = np.frombuffer(bitmap.value, np.uint64)
        part, count = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            n, counts, rows = [], [], []
            for text in batch.column("text").to_pylist():
                w = word_hashes(words(text))
                h, at, size = fingerprints(w, short)
                slot = h >> np.uint64(64 - bits)
                hit = (set_bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) != 0
                n.append(len(w))
                counts.append(int(hit.sum()))
                rows.append(_print_columns(w, h[hit], at[hit], size[hit]))
            keys = np.arange(batch.num_rows) + part + count
            count += batch.num_rows
            struct = pa.StructArray.from_arrays(_joined(rows), [name for name, _ in _PRINTS])
            prints = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), struct)
            yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), prints], ["row_key", "doc_id", "text_key", "n_words", "prints"])

    return run


def digest_of(items) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _shared_words(side: int) -> Column:
    """How many words of a document's and an item's neighbours are equal, from the gram on; a word beyond an end is none."""
    steps = range(side * REACH, (side + 1) * REACH)
    out = F.lit(0)
    for k in reversed(steps):
        out = F.when((F.col(f"z.w{k}") == F.col(f"i.w{k}")) & (F.col(f"z.w{k}") != 0), 1 + out).otherwise(0)
    return out


def _found_and_spans(docs: DataFrame, items: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """A row for each document row, and the hits' counts by ``row_key``."""
    spark = docs.sparkSession
    items = items.select("item_id", "text").distinct()
    items = scratch.save(items.withColumn("item_key", F.monotonically_increasing_id()), "items")
    columns = ", ".join(f"{name} {'bigint' if kind == pa.int64() else 'int'}" for name, kind in _PRINTS)
    prints = scratch.save(items.select("item_key", "text").mapInArrow(_of_items, f"item_key bigint, {columns}"), "prints")
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * prints.count()).bit_length()))
    # the bitmap by words of 64 bits, put together by Spark: MOST_BITS bound what reaches the driver
    slot = F.shiftrightunsigned("fp", 64 - bits)
    set_words = prints.groupBy(F.shiftright(slot, 6).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - bits}) & 63 AS int))")).alias("bits")).toArrow()
    bitmap = np.zeros(2 ** (bits - 6), np.int64)
    bitmap[set_words["word"].to_numpy()] = set_words["bits"].to_numpy()
    short = sorted(r["size"] for r in prints.where(F.col("size") < WINDOW).select("size").distinct().collect())
    shared = spark.sparkContext.broadcast(bitmap.tobytes())
    found = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        _of_documents(shared, bits, short),
        f"row_key bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, n_words bigint, prints array<struct<{columns.replace(' ', ':').replace(',:', ',')}>>",
    )
    found = scratch.save(found, "found")
    places = found.where("size(prints) > 0").select("row_key", F.explode("prints").alias("z"))
    pairs = places.join(prints.alias("i"), (F.col("z.fp") == F.col("i.fp")) & (F.col("z.size") == F.col("i.size")))
    back, on, whole = _shared_words(0), _shared_words(1), F.col("z.size") == WINDOW
    pairs = pairs.where(~whole | (back + on >= REACH))
    lo = F.when(whole, F.col("z.at") - back).otherwise(F.col("z.at"))
    hi = F.when(whole, F.col("z.at") + GRAM + on).otherwise(F.col("z.at") + F.col("z.size"))
    hits = scratch.save(pairs.select("row_key", "item_key", lo.alias("lo"), hi.alias("hi")), "hits")
    # a document's marked words: each span counts from where the earlier ones end
    spans = hits.select("row_key", "lo", "hi").distinct()
    before = F.max("hi").over(Window.partitionBy("row_key").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("hi") - F.greatest("lo", F.coalesce(before, F.col("lo")))))
    spans = spans.groupBy("row_key").agg(F.sum("new").cast("bigint").alias("n_hit"))
    named = hits.select("row_key", "item_key").distinct().join(items.select("item_key", "item_id"), "item_key").select("row_key", "item_id").distinct()
    named = named.groupBy("row_key").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    named = named.select("row_key", "n_items", F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    return found, spans.join(named, "row_key")


def contamination(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``, one row per row of ``docs(doc_id, text, ...)``.

    Windows come from ``items(item_id, text, ...)``. Null and empty texts have no words and no hits; items without
    words have no windows. Items without an id mark words too and count as one item, which has no place in the digest. Repeated rows and null document
    ids keep their own result rows, repeated item rows count once by id. Texts of any length are read whole. Other columns are ignored.
    No documents give no rows; no items, rows without hits.
    """
    found, spans = _found_and_spans(docs, items, scratch or Scratch(docs.sparkSession, "winnow"))
    out = found.select("row_key", "doc_id", "n_words").join(spans, "row_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        "doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.lit(digest_of([]))).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated")
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``docs`` without the rows whose text shares a window with an item; all columns stay. The cases are those of ``contamination``."""
    found, spans = _found_and_spans(docs, items, scratch or Scratch(docs.sparkSession, "winnow"))
    bad = found.join(spans.where("n_hit > 0"), "row_key").select("doc_id", "text_key").distinct()
    # renamed first, so that no column of the input can clash
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    kept = own.join(bad, F.col(names["doc_id"]).eqNullSafe(F.col("doc_id")) & (F.xxhash64(names["text"]) == F.col("text_key")), "left_anti")
    return kept.select(*(F.col(n).alias(c) for c, n in names.items()))
