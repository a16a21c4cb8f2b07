"""Collocations of two and three words, counted in tiles of directly addressed pairs.

Words get ids by falling frequency, so frequent pairs lie close together in the square of ids. The corner of the square is cut into small tiles, which
are dense, and the rest into large ones, which are sparse. Tasks sort the pair codes of some millions of words at a time and send each tile's part as one row of sorted
(place, count) arrays. A dense tile sums its parts by ``bincount`` over direct addresses, a sparse one by sorting places. Pairs that are frequent enough are
then ranked in their turn, and (pair, word) is counted in the same way for three words.

A phrase's words and its parts are at least as frequent as itself, so only words and pairs with the least count take part. The HEAD_WORDS most frequent
words and HEAD_PAIRS most frequent pairs are sent to the tasks, which bounds what is sent whatever the input. Phrases with
words or pairs beyond these are counted by Spark as strings, behind a bitmap of fixed size that tells which words and pairs beyond the head have the
least count; so nothing is lost. A tile's parts meet first within groups of neighbouring partitions and then across them.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from cellwatch.llm.scratch import Scratch

#: Bits of a place in the side of a dense tile, and of a sparse one, which is the side of all dense tiles together. A dense tile's counts take 8 bytes for each
#: of its pairs, a sparse tile's 12 bytes for each pair that occurs.
SIDE_BITS, FAR_BITS = 11, 13
DENSE_TILES = 1 << 2 * (FAR_BITS - SIDE_BITS)
#: Places of a sparse tile that are held before equal ones are joined.
HELD_PLACES = 1 << 22
#: Words and pairs sent to the tasks; longer words than this are beyond the head.
HEAD_WORDS, HEAD_PAIRS, HEAD_BYTES = 1 << 19, 1 << 21, 64
#: Bits of the bitmap of frequent words and pairs beyond the head.
SCREEN_BITS = 1 << 26
#: Distinct words, and words in a row, that a task holds at once.
HELD_WORDS, HELD_IDS = 1 << 19, 1 << 22
#: Partitions whose parts of a tile meet first.
NEIGHBOURS = 64
#: Shares of the first ranking, so that no task ranks all phrases of a language.
SHARES = 64
#: Lower-cases A-Z, and makes one sign of all that ends a piece.
_TABLE = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SLICE = 256
#: Of a word without an id: it breaks phrases, or may be a frequent word beyond the head.
_RARE, _BEYOND = -1, -2


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _SLICE):
            part = batch.slice(lo, _SLICE)
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                yield lang, (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            words = [None, *(w.decode("utf-8", "surrogatepass") for w in own)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(words, pa.string()), pa.array([own.total(), *own.values()], pa.int64())], ["lang", "word", "n"])
        counts.clear()

    for lang, text in _texts(batches):
        counts.setdefault(lang, Counter()).update(text.split())
        if sum(map(len, counts.values())) > HELD_WORDS:
            yield from told()
    yield from told()


def _numbered(df: DataFrame, order: list, scratch: Scratch, name: str) -> DataFrame:
    """``df`` with ``id``: places from 0 in the given order, by a range-partitioned sort and the counts of its partitions."""
    rows = scratch.save(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), f"{name}-sorted")
    rows = rows.withColumns({"part": F.shiftright("at", 33), "at": F.expr("at & 8589934591")})
    sizes = rows.groupBy("part").agg(F.count("*").alias("n_rows"))  # a row for each partition
    before = F.sum("n_rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return scratch.save(rows.join(starts, "part").select(*df.columns, F.expr("before + at").alias("id")), name)


def _screen(phrases: DataFrame) -> bytes | None:
    """Bits by checksum of ``(lang, phrase)``; null without rows. At most SCREEN_BITS bits reach the driver."""
    slot = F.crc32(F.encode(F.concat("lang", F.lit("\0"), "phrase"), "utf-8")) % SCREEN_BITS + 1
    blocks = phrases.select(slot.alias("slot")).groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bits")).collect()
    if not blocks:
        return None
    out = bytearray(SCREEN_BITS // 8)
    for bucket, bits in blocks:
        lo = (bucket - 1) * 4096
        out[lo : lo + len(bits)] = bits[: len(out) - lo]
    return bytes(out)


class Head:
    """What a task knows: ids of head words, ids of head pairs by code, and the screens of those beyond."""

    def __init__(self, langs: list[str], words: list[str], beyond: bytes | None, codes: np.ndarray | None = None, pair_ids: np.ndarray | None = None, beyond_pairs: bytes | None = None) -> None:
        self.words: dict[str, dict[bytes, int]] = {}
        for i, (lang, word) in enumerate(zip(langs, words)):
            if lang is not None:
                self.words.setdefault(lang, {})[word.encode("utf-8", "surrogatepass")] = i
        self.beyond, self.codes, self.pair_ids, self.beyond_pairs = beyond, codes, pair_ids, beyond_pairs

    @staticmethod
    def _in(screen: bytes | None, lang: str, phrase: bytes) -> bool:
        if screen is None:
            return False
        slot = zlib.crc32(phrase, zlib.crc32(lang.encode("utf-8", "surrogatepass") + b"\0")) % SCREEN_BITS
        return bool(screen[slot >> 3] >> (slot & 7) & 1)

    def ids(self, lang: str, text: bytes) -> tuple[np.ndarray, list[bytes]]:
        """The ids of a text's words, with a rare one after each piece; the words themselves where some may be beyond the head."""
        get = self.words.get(lang, {}).get
        ids: list[int] = []
        kept: list[bytes] = []
        for piece in text.split(b"\n"):
            words = piece.split()
            if self.beyond is None:
                ids += [get(w, _RARE) for w in words]
            else:
                found = [get(w, _RARE) for w in words]
                ids += [_BEYOND if i == _RARE and self._in(self.beyond, lang, w) else i for i, w in zip(found, words)]
            ids.append(_RARE)
            if self.beyond is not None or self.beyond_pairs is not None:
                kept += words
                kept.append(b"")
        return np.array(ids, np.int64), kept

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """By place, the id of the head pair that starts there, or _RARE."""
        out = np.full(len(ids), _RARE)
        both = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        wanted = ids[both] << 31 | ids[both + 1]
        if len(self.codes) and len(wanted):
            at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
            out[both] = np.where(self.codes[at] == wanted, self.pair_ids[at], _RARE)
        return out


_heads: dict[str, Head] = {}


def _head(name: str, sent: Broadcast) -> Head:
    """One for each worker process, and the latest only."""
    if name not in _heads:
        _heads.clear()
        _heads[name] = Head(*sent.value)
    return _heads[name]


def _code(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A pair's tile and its place there in one number, the tile in front."""
    dense = np.maximum(i, j) < 1 << FAR_BITS
    bits = np.where(dense, SIDE_BITS, FAR_BITS)
    mask = (1 << bits) - 1
    tile = np.where(dense, (i >> SIDE_BITS) << (FAR_BITS - SIDE_BITS) | j >> SIDE_BITS, DENSE_TILES + ((i >> FAR_BITS) << (31 - FAR_BITS) | j >> FAR_BITS))
    return tile << 2 * FAR_BITS | (i & mask) << bits | j & mask


def _pairs_of(tile: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``_code`` has put together."""
    bits, per_row, own = (SIDE_BITS, FAR_BITS - SIDE_BITS, tile) if tile < DENSE_TILES else (FAR_BITS, 31 - FAR_BITS, tile - DENSE_TILES)
    return (own >> per_row) << bits | place >> bits, (own & ((1 << per_row) - 1)) << bits | place & ((1 << bits) - 1)


_PARTS = "tile bigint, neighbours int, places binary, counts binary, lang string, phrase string, n bigint"


def _tile_rows(codes: np.ndarray, counts: np.ndarray, group: int) -> Iterator[tuple]:
    tiles = codes >> 2 * FAR_BITS
    places = (codes & ((1 << 2 * FAR_BITS) - 1)).astype("<i4")
    cuts = np.flatnonzero(np.diff(tiles, prepend=-1)) if len(tiles) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(tiles)]):
        yield int(tiles[lo]), group, places[lo:hi].tobytes(), counts[lo:hi].astype("<i8").tobytes(), None, None, None


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in _PARTS.split(", ")]
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[2] or b"") * 3 + 100
        if size > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)


def _count_phrases(name: str, sent: Broadcast, size: int):
    """A task's counts of phrases of two or three words: parts of tiles, and phrases beyond the head as strings."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        head, group = _head(name, sent), TaskContext.get().partitionId() // NEIGHBOURS
        held: list[np.ndarray] = []
        n_held = 0
        beyond: dict[str, Counter] = {}

        def told() -> Iterator[tuple]:
            codes, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64),) * 2
            held.clear()
            yield from _tile_rows(codes, counts, group)

        def told_beyond() -> Iterator[tuple]:
            for lang, own in beyond.items():
                for phrase, n in own.items():
                    yield None, group, None, None, lang, phrase.decode("utf-8", "surrogatepass"), n
            beyond.clear()

        for lang, text in _texts(batches):
            ids, words = head.ids(lang, text)
            if size == 2:
                known = (ids[:-1] >= 0) & (ids[1:] >= 0)
                held.append(_code(ids[:-1][known], ids[1:][known]))
                rest = np.flatnonzero((ids[:-1] != _RARE) & (ids[1:] != _RARE) & ~known).tolist() if words else ()
            else:
                pairs = head.pairs(ids)
                known = (pairs[:-2] >= 0) & (pairs[1:-1] >= 0)
                held.append(_code(pairs[:-2][known], ids[2:][known]))
                rest = ()
                if words:
                    may = pairs >= 0
                    for at in np.flatnonzero((ids[:-1] != _RARE) & (ids[1:] != _RARE) & ~may[:-1]).tolist():
                        may[at] = head._in(head.beyond_pairs, lang, b" ".join(words[at : at + 2]))
                    rest = np.flatnonzero(may[:-2] & may[1:-1] & ~known).tolist()
            if rest:
                beyond.setdefault(lang, Counter()).update(b" ".join(words[at : at + size]) for at in rest)
                if sum(map(len, beyond.values())) > HELD_WORDS:
                    yield from told_beyond()
            n_held += len(ids)
            if n_held > HELD_IDS:
                yield from told()
                n_held = 0
        yield from told()
        yield from told_beyond()

    return lambda batches: _batches(rows(batches))


def _summed(places: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places and their sums, of a sparse tile."""
    place, n = np.concatenate(places), np.concatenate(counts)
    order = np.argsort(place, kind="stable")
    place, n = place[order], n[order]
    cuts = np.flatnonzero(np.diff(place, prepend=-1))
    return place[cuts], np.add.reduceat(n, cuts)


def _tile_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of parts sorted by tile: each tile's places and sums. Holds one tile, and as many places again that are not yet added."""
    area = 1 << 2 * SIDE_BITS
    tile = group = None
    places: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    dense = None
    n_held, room = 0, 0

    def add() -> None:
        nonlocal dense, n_held, room
        if tile >= DENSE_TILES:
            place, n = _summed(places, counts)
            places[:], counts[:], n_held, room = [place], [n], len(place), max(HELD_PLACES, 2 * len(place))
            return
        # sums stay below 2 ** 53, so doubles are exact
        more = np.bincount(np.concatenate(places), np.concatenate(counts), area).astype(np.int64)
        dense = more if dense is None else dense + more
        places.clear()
        counts.clear()
        n_held = 0

    def ended() -> tuple[int, int, np.ndarray, np.ndarray]:
        if dense is not None and places:
            add()
        if dense is None:
            return tile, group, *_summed(places, counts)
        at = np.flatnonzero(dense)
        return tile, group, at, dense[at]

    for batch in batches:
        for own, near, place, n in zip(*(batch.column(c).to_pylist() for c in ("tile", "neighbours", "places", "counts"))):
            if own != tile:
                if tile is not None:
                    yield ended()
                tile, group, dense, n_held, room = own, near, None, 0, area >> 3 if own < DENSE_TILES else HELD_PLACES
                places, counts = [], []
            places.append(np.frombuffer(place, "<i4"))
            counts.append(np.frombuffer(n, "<i8"))
            n_held += len(places[-1])
            if n_held > room:
                add()
    if tile is not None:
        yield ended()


def _frequent(parts: DataFrame, least: int) -> DataFrame:
    """``(i, j, a)`` of the pairs with the least count."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(row for tile, group, place, n in _tile_sums(batches) for row in _tile_rows((np.int64(tile) << 2 * FAR_BITS) | place.astype(np.int64), n, group))

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, _, place, n in _tile_sums(batches):
            i, j = _pairs_of(tile, place[n >= least].astype(np.int64))
            n = n[n >= least]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(j, pa.int64()), pa.array(n, pa.int64())], ["i", "j", "a"])

    near = parts.repartition("tile", "neighbours").sortWithinPartitions("neighbours", "tile")
    # within a partition a tile may come once for each group of neighbours; the second meeting joins these
    return near.mapInArrow(meet, _PARTS).repartition("tile").sortWithinPartitions("tile").mapInArrow(end, "i bigint, j bigint, a bigint")


def _counted(docs: DataFrame, sent: tuple, size: int, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``(i, j, a)`` of the head's pairs, and ``(lang, phrase, a)`` of the others, with the least count."""
    value = docs.sparkSession.sparkContext.broadcast(sent)
    parts = scratch.save(docs.mapInArrow(_count_phrases(uuid.uuid4().hex, value, size), _PARTS), f"parts-{size}")
    head = scratch.save(_frequent(parts.where("tile IS NOT NULL").select(*(x.split()[0] for x in _PARTS.split(", "))), least), f"head-{size}")
    rest = parts.where("tile IS NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("a")).where(F.col("a") >= least)
    return head, rest


def frequent_phrases(docs: DataFrame, least: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(lang, n)``, then ``(lang, w1, a)``, ``(lang, w1, w2, a)`` and ``(lang, w1, w2, w3, a)`` of phrases with the least count."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    counted = texts.mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("a"))
    counted = scratch.save(counted.where(F.col("word").isNull() | (F.col("a") >= least)), "counted")
    totals = counted.where("word IS NULL").select("lang", F.col("a").alias("n"))
    # words that are too long for the head go last
    short = F.octet_length("word") <= HEAD_BYTES
    words = _numbered(counted.where("word IS NOT NULL"), [short.desc(), F.desc("a"), "lang", "word"], scratch, "words")
    sent = words.where((F.col("id") < HEAD_WORDS) & short).orderBy("id").select("lang", "word").toArrow()
    head = [sent.column("lang").to_pylist(), sent.column("word").to_pylist()]
    beyond = _screen(words.where((F.col("id") >= HEAD_WORDS) | ~short).select("lang", F.col("word").alias("phrase")))

    near, rest = _counted(texts, (*head, beyond), 2, least, scratch)
    named = words.select("id", "lang", "word")
    pairs = near.join(named.select(F.col("id").alias("i"), "lang", F.col("word").alias("w1")), "i").join(named.select(F.col("id").alias("j"), F.col("word").alias("w2")), "j")
    split = [F.split("phrase", " ")[k].alias(f"w{k + 1}") for k in range(3)]
    none = F.lit(None).cast("bigint")
    pairs = pairs.select("i", "j", "lang", "w1", "w2", "a").union(rest.select(none, none, "lang", *split[:2], "a"))
    pairs = _numbered(pairs, [F.col("i").isNull(), F.desc("a"), "lang", "w1", "w2"], scratch, "pairs")
    inner = (F.col("id") < HEAD_PAIRS) & F.col("i").isNotNull()
    sent = pairs.where(inner).select(F.expr("shiftleft(i, 31) | j").alias("code"), "id").toArrow()
    codes, ids = sent.column("code").to_numpy(), sent.column("id").to_numpy()
    order = np.argsort(codes)
    beyond_pairs = _screen(pairs.where(~inner).select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase")))

    near, rest = _counted(texts, (*head, beyond, codes[order], ids[order], beyond_pairs), 3, least, scratch)
    triples = near.join(pairs.select(F.col("id").alias("i"), "lang", "w1", "w2"), "i").join(named.select(F.col("id").alias("j"), F.col("word").alias("w3")), "j")
    triples = scratch.save(triples.select("lang", "w1", "w2", "w3", "a").union(rest.select("lang", *split, "a")), "triples")
    return totals, words.select("lang", F.col("word").alias("w1"), "a"), pairs.select("lang", "w1", "w2", "a"), triples


def _score(a: str, left: str, right: str):
    d = lambda c: f"CAST({c} AS DECIMAL(15, 0))"
    return F.expr(f"CAST(CAST(1000000 AS DECIMAL(7, 0)) * ({d(a)} * {d(a)}) AS DECIMAL(38, 0)) div CAST({d(left)} * {d(right)} AS DECIMAL(38, 0))")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside_pct: int = 50) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first phrases of two and three words.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its weakest cut, ``n`` all words of the language; the score is a * a / (l * r) in whole
    millionths, exact for counts up to 10 ** 15. A pair inside a phrase of three words with ``inside_pct`` of its count or more is dropped.
    Ties go by ``a``, then by the phrase's bytes. A null text has no words, a null language is ``und``, repeated rows count each time, a text may be of any length,
    an empty table gives no rows, and other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    totals, words, pairs, triples = frequent_phrases(docs, least, scratch)
    inside = triples.select("lang", "w1", "w2", "a").union(triples.select("lang", "w2", "w3", "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longest"))
    left = words.withColumnRenamed("a", "l")
    right = lambda w: words.select("lang", F.col("w1").alias(w), F.col("a").alias("r"))
    two = pairs.join(inside, ["lang", "w1", "w2"], "left").where((F.col("longest").isNull()) | (100 * F.col("longest") < inside_pct * F.col("a"))).drop("longest")
    two = two.join(left, ["lang", "w1"]).join(right("w2"), ["lang", "w2"]).select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score("a", "l", "r").alias("score"))
    three = triples.join(left, ["lang", "w1"]).join(pairs.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r")), ["lang", "w2", "w3"])
    three = three.join(pairs.select("lang", "w1", "w2", F.col("a").alias("l2")), ["lang", "w1", "w2"]).join(words.select("lang", F.col("w1").alias("w3"), F.col("a").alias("r2")), ["lang", "w3"])
    cut = lambda k, x, y: F.struct(_score("a", x, y).alias("score"), F.lit(k).alias("k"), F.col(x).alias("l"), F.col(y).alias("r"))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.least(cut(1, "l", "r"), cut(2, "l2", "r2")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    best = two.union(three).withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


PHRASES_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS MATERIALIZED (SELECT row_number() OVER () AS piece, lang, ws FROM (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM t) WHERE len(ws) > 0),
w AS MATERIALIZED (SELECT lang, w1, CASE WHEN i + 1 <= n THEN w2 END AS w2, CASE WHEN i + 2 <= n THEN w3 END AS w3
      FROM (SELECT lang, unnest(ws) AS w1, unnest(ws[2:]) AS w2, unnest(ws[3:]) AS w3, unnest(range(1, len(ws) + 1)) AS i, len(ws) AS n FROM p)),
f1 AS MATERIALIZED (SELECT lang, w1, count(*) AS a FROM w GROUP BY ALL),
f2 AS MATERIALIZED (SELECT lang, w1, w2, count(*) AS a FROM w WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS MATERIALIZED (SELECT lang, w1, w2, w3, count(*) AS a FROM w WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f1 GROUP BY lang),
cut AS (SELECT f2.lang, w1 || ' ' || w2 AS phrase, f2.a, 1 AS k, x.a AS l, y.a AS r FROM f2 JOIN f1 x USING (lang, w1) JOIN f1 y ON y.lang = f2.lang AND y.w1 = f2.w2
  UNION ALL SELECT f3.lang, w1 || ' ' || f3.w2 || ' ' || w3, f3.a, 1, x.a, y.a FROM f3 JOIN f1 x USING (lang, w1) JOIN f2 y ON y.lang = f3.lang AND y.w1 = f3.w2 AND y.w2 = f3.w3
  UNION ALL SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || w3, f3.a, 2, x.a, y.a FROM f3 JOIN f2 x USING (lang, w1, w2) JOIN f1 y ON y.lang = f3.lang AND y.w1 = f3.w3),
s AS (SELECT *, CAST(1000000::HUGEINT * a * a // (l::HUGEINT * r) AS BIGINT) AS score FROM cut),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, phrase, max(a) AS longest FROM (SELECT lang, w1 || ' ' || w2 AS phrase, a FROM f3 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM f3) GROUP BY ALL),
o AS (SELECT b.lang, b.phrase, a, l, r, score FROM b LEFT JOIN i USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT o.lang, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o JOIN n ON n.lang = o.lang QUALIFY rank <= 2000
"""
