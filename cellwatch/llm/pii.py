"""Personal data: four base kinds, and identifiers that bootstrapped contexts discover.

The base rules give every span of the four kinds. Beyond them, identifiers of other looks, and secrets, are found by their
surroundings. An instance is a token with a digit or an @; its patterns are lexical contexts: one or two words before it, the word behind it, the words on
both sides, and the word before a mark such as a colon. Spans of the base kinds are the seeds, and so are long hexadecimal tokens for secrets, which count as found only where a
pattern says so. Spark scores the graph of patterns and instances in rounds: a pattern is of the commonest kind among its known instances, and its precision is their share
of all distinct instances that it occurs with. Precise patterns with enough known instances are kept; an instance that they make sure enough is known in the next round, and lends
weight to its other patterns. In the end tokens in the places of kept patterns that no base rule took become further spans.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cellwatch.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: A kind without base rule: its seeds are spans only where a kept pattern has them.
SECRET = len(KINDS)
ALL_KINDS = (*KINDS, "secret")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits never gives back, for what follows it is never a digit: linear on any text.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
#: A pattern needs this precision, and an instance this confidence to count as known.
PRECISION = 0.8
ROUNDS = 3


def least_seeds(known: int) -> int:
    """Distinct known instances that a pattern of a kind needs, by how many the table has of that kind."""
    return max(3, round(math.log2(1 + known)))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the base kinds, sorted: leftmost matches of each kind that do not overlap, and of these
    the ones that hold. Linear in the text's length."""
    out = []
    taken = 0
    for m in _AT.finditer(text):
        start = at = m.start()
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, 0, m.end()))
            taken = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NOT_DIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{s}:{e}" for s, k, e in spans)


#: A candidate: a token with a digit or an @. Possessive, so linear.
_TOKEN = re.compile(r"(?<![^\s\"'()<>\[\]=])(?=[^\s\"'()<>\[\]=@0-9]*+[@0-9])[^\s\"'()<>\[\]=]++")
#: Without one of these a text has neither spans nor candidates.
_ANY = re.compile(r"[0-9@]")
_WORD = re.compile(r"\w+")
_HEX = re.compile(r"(?=[a-f]*+[0-9])(?=[0-9]*+[a-f])[0-9a-f]{32,}+")


class Words:
    """A text's words, and the lexical contexts of its places."""

    def __init__(self, text: str) -> None:
        self.text = text
        found = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def word(self, k: int) -> str:
        return self.text[self.starts[k] : self.ends[k]].lower()

    def contexts(self, start: int, end: int) -> list[str]:
        """The word before, the two before, the word behind, those on each side, and the word before a mark."""
        k, n = bisect_right(self.ends, start) - 1, bisect_left(self.starts, end)
        out = []
        behind = self.word(n) if n < len(self.starts) else None
        if behind is not None:
            out.append(f"_ {behind}")
        if k >= 0:
            before = self.word(k)
            out.append(f"{before} _")
            if k >= 1:
                out.append(f"{self.word(k - 1)} {before} _")
            if behind is not None:
                out.append(f"{before} _ {behind}")
            mark = self.text[self.ends[k] : start].strip(" \t\r\n\"'`()<>[]")[-1:]
            if mark and mark in ":=#":
                out.append(f"{before} {mark} _")
        return out


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, str]]:
    """``(start, end, kind or -1, hash of the instance, context)`` of the seeds and of tokens that look like identifiers and meet no base span."""
    out, words = [], Words(text)

    def add(start: int, end: int, kind: int) -> None:
        instance = xxhash.xxh3_64_intdigest(text[start:end].encode("utf-8", "surrogatepass")) - (1 << 63)
        out.extend((start, end, kind, instance, c) for c in words.contexts(start, end))

    for start, kind, end in spans:
        add(start, end, kind)
    taken = sorted((s, e) for s, _, e in spans)
    i, reach = 0, 0  # spans from i on may lie ahead; those before end at reach
    for m in _TOKEN.finditer(text):
        start, end = m.start(), m.end()
        while end > start and not text[end - 1].isalnum():
            end -= 1
        if end == start:
            continue
        while i < len(taken) and taken[i][0] < end:
            reach = max(reach, taken[i][1])
            i += 1
        if reach > start:
            continue
        add(start, end, SECRET if _HEX.fullmatch(text, start, end) else -1)
    return out


_SCAN = "row_key bigint, doc_id bigint, base array<struct<start:int,kind:int,end:int>>, found array<struct<start:int,end:int,kind:int,instance:bigint,context:string>>"
_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_FOUND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32()), ("instance", pa.int64()), ("context", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count = TaskContext.get().partitionId() << 40, 0
    for batch in batches:
        base, found = [], []
        for value in batch.column("text"):
            text = value.as_py() or ""
            if not _ANY.search(text):
                base.append([])
                found.append([])
                continue
            spans = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            found.append([dict(zip(("start", "end", "kind", "instance", "context"), c)) for c in candidates(text, spans)])
        keys = pa.array(range(part + count, part + count + batch.num_rows), pa.int64())
        count += batch.num_rows
        yield pa.RecordBatch.from_arrays([keys, batch.column("doc_id"), pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))], ["row_key", "doc_id", "base", "found"])


def score_patterns(found: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """``(context, kind, precision)`` of the kept patterns, from ``found(kind, instance, context)`` with kind -1 for tokens that are no seeds.

    Distinct instances count, so copies of a document lend a pattern no weight. Of equally common kinds a pattern is of the first. All steps
    are aggregations and equi-joins of edges; only the kinds' counts of seeds reach the driver.
    """
    edges = scratch.save(found.groupBy("context", "instance").agg(F.max("kind").alias("own")), "edges")
    seeds = edges.where("own >= 0").groupBy("own").agg(F.approx_count_distinct("instance", 0.01).alias("n")).collect()
    need = F.coalesce(*(F.when(F.col("kind") == r["own"], least_seeds(r["n"])) for r in seeds), F.lit(least_seeds(0)))
    support = edges.groupBy("context").agg(F.count("*").alias("support"))
    known = edges.select("context", "instance", F.col("own").alias("kind")).where("kind >= 0")
    for k in range(rounds):
        counts = known.groupBy("context", "kind").agg(F.count("*").alias("n"))
        best = counts.groupBy("context").agg(F.max(F.struct("n", F.negative("kind").alias("k"))).alias("b"))
        patterns = best.select("context", F.negative("b.k").alias("kind"), F.col("b.n").alias("n")).where(F.col("n") >= need).join(support, "context")
        patterns = patterns.withColumn("precision", F.col("n") / F.col("support")).where(F.col("precision") >= PRECISION)
        patterns = scratch.save(patterns.select("context", "kind", "precision"), f"patterns-{k}")
        if k + 1 == rounds:
            break
        # an instance is as sure as its patterns together: one minus the product of their doubts
        doubt = F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("precision"))))
        sure = edges.where("own < 0").join(patterns, "context").groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("c")).where(F.col("c") >= PRECISION)
        sure = sure.groupBy("instance").agg(F.max(F.struct("c", F.negative("kind").alias("k"))).alias("b")).select("instance", F.negative("b.k").alias("kind"))
        sure = scratch.save(sure, f"sure-{k}")
        if sure.isEmpty():
            break
        known = edges.where("own >= 0").select("context", "instance", F.col("own").alias("kind")).union(edges.where("own < 0").join(sure, "instance").select("context", "instance", "kind"))
    return patterns


def find_personal_data(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(doc_id, base, spans)``: arrays of ``struct(start, kind, end)`` in code points, sorted; ``base`` of the base rules,
    ``spans`` with the discovered ones as well. Kinds are numbered as in ``ALL_KINDS``.

    One row per row of ``docs(doc_id, text, ...)``; null and empty texts have no spans. Repeated rows and null ids keep
    their rows; other columns are ignored. Discovered spans meet no base span and not each other. Texts of any length are read whole; an empty table gives an empty one.
    """
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    scanned = scratch.save(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_scan, _SCAN), "scanned")
    places = scanned.where("size(found) > 0").select("row_key", F.explode("found").alias("f")).select("row_key", "f.*")
    kept = score_patterns(places.select("kind", "instance", "context"), scratch)
    new = places.where(f"kind IN (-1, {SECRET})").withColumnRenamed("kind", "own").join(kept, "context").where(f"own < 0 OR kind = {SECRET}")
    # a token may be found by several patterns: the most precise one names it, of equal ones the first kind
    new = new.groupBy("row_key", "start", "end").agg(F.max(F.struct("precision", F.negative("kind").alias("k"))).alias("b")).select("row_key", "start", F.negative("b.k").alias("kind"), "end")
    new = new.groupBy("row_key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("new"))
    out = scanned.select("row_key", "doc_id", "base").join(new, "row_key", "left")
    return out.select("doc_id", "base", F.sort_array(F.concat("base", F.coalesce("new", F.array().cast("array<struct<start:int,kind:int,end:int>>")))).alias("spans"))


def as_text(spans: str):
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, ALL_KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def personal_data_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every row."""
    found = find_personal_data(docs)
    of = lambda k: F.filter("base", lambda s: s["kind"] == k)  # noqa: E731 a second parameter of the inner one would be the span's place in the array
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans"))
