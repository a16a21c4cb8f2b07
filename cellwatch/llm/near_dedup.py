"""MinHash near-duplicate detection by a chosen-path set similarity join.

Every document is the set of its distinct five-word shingles. Documents with equal sets form one
class, and one member stands for it. In each of several independent trees a class follows the paths
that its minwise tokens choose: at each level the tree fixes ``BRANCH`` minwise positions, and the
class goes to the child named by its path so far and its token at that position. Nodes of at most
``LEAF`` classes are compared exhaustively, larger ones branch again. A pair of similarity s misses
all common children of a node with probability (1 - s) ** BRANCH, so the number of trees follows from
the target recall. Links are confirmed on the full sets.

Pairs whose minwise tokens agree too seldom for the threshold are screened out before any text is fetched. Small nodes
compare all others. A node of the last level may stay large; as only components are asked for, it compares no pair that
is already known to be connected: first every class is compared with the node's leaders, then, if it still holds several
components, pairs of different components. A shingle that no other class of such nodes has can't be shared,
so the others of each class bound the similarity of a pair from above, exactly. In a large group of near copies the
copies that were changed too much to be linked have too many shingles of their own, and pair with nothing;
the bound and the minwise tokens leave few pairs to confirm. Large nodes are dealt into blocks, and each two blocks are a task's work of their own.

The screen by minwise tokens drops pairs at the threshold with a probability of some 3 in a million each; ``screened=False`` leaves it out, and then the texts
of every pair of a small node whose sizes allow a link are compared. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from functools import reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cellwatch.llm.components import components
from cellwatch.llm.scratch import Scratch

SHINGLE = 5
LEAF = 16
DEPTH = 3
BRANCH = 2
RECALL = 0.99999
#: Minwise tokens of a class at least; those that steer no path still screen pairs.
SCREEN = 96
#: Sets of at most so many shingles (4 bytes of each) are compared before a pair leaves its node.
SMALL = 512
#: Classes of a node in one block; each two blocks of a large node are compared on their own.
BLOCK = 512
#: Entries of a worker's word cache; a miss only costs time.
WORD_CACHE = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _WordHash()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles: A-Z lower-cased, words between ASCII white space;
    fewer than five words form one shingle; no words, none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)] if n else [], np.uint64)
    w = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    h = w[: n - SHINGLE + 1].copy()
    for j in range(1, SHINGLE):
        h *= _STEP
        h += w[j : n - SHINGLE + 1 + j]
        h ^= h >> np.uint64(29)
    h *= _MIX
    return np.unique(h ^ (h >> np.uint64(32)))


def trees_for(similarity: float, recall: float = RECALL, depth: int = DEPTH, branch: int = BRANCH) -> int:
    """Trees after which a pair at the threshold is missed with probability 1 - recall at most."""
    miss = 1 - (1 - (1 - similarity) ** branch) ** depth
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def _hashers(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, k, dtype=np.uint64)


def minwise(shingles: np.ndarray, k: int) -> np.ndarray:
    """The k minwise tokens of a set that is not empty."""
    a, b = _hashers(k)
    best = np.full(k, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(shingles), 2048):
        part = (shingles[i : i + 2048, None] * a + b) >> np.uint64(32)
        np.minimum(best, part.min(axis=0).astype(np.uint32), out=best)
    return best.view(np.int32)


def _sketches(k: int):
    def run(batches):
        for batch in batches:
            n, keys, rows = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                rows.append(minwise(s, k) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(rows, pa.list_(pa.int32()))],
                ["doc_id", "text_key", "n_shingles", "set_key", "tokens"],
            )

    return run


def _shingle_rows(batches):
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(owner)), pa.array(flat)], ["cid", "shingle"])


def _small_sets(batches):
    for batch in batches:
        sets = [shingle_set(t) for t in batch.column("text").to_pylist()]
        rows = [(x & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) if len(x) <= SMALL else None for x in sets]
        yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(rows, pa.list_(pa.int32()))], ["cid", "small"])


def _confirm(similar_pct: int):
    def run(batches):
        seen: OrderedDict[int, np.ndarray] = OrderedDict()

        def of(key: int, text: str) -> np.ndarray:
            if key in seen:
                seen.move_to_end(key)
            else:
                seen[key] = shingle_set(text)
                if len(seen) > 64:
                    seen.popitem(last=False)
            return seen[key]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(a, b)):
                s, t = of(x, batch.column("text_a")[i].as_py()), of(y, batch.column("text_b")[i].as_py())
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= similar_pct * (len(s) + len(t) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    return run


def _nodes(scratch: Scratch, classes: DataFrame, trees: int) -> DataFrame:
    """Leaf nodes ``(path, cid, n, size)`` of at least two classes."""
    position = lambda tree, level, j: (tree * DEPTH + level) * BRANCH + j

    def children(rows: DataFrame, path, level: int) -> DataFrame:
        rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(BRANCH - 1)))).withColumn("p", position(F.col("tree"), F.lit(level), F.col("j")))
        return rows.select("tree", F.concat("turns", F.array("j")).alias("turns"), F.xxhash64(path, F.col("p"), F.get(F.col("tokens"), F.col("p"))).alias("path"), "cid", "n")

    roots = classes.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("turns", F.array().cast("array<int>"))
    level = children(roots, F.lit(0), 0)
    leaves = []
    for d in range(DEPTH):
        size = level.groupBy("path").agg(F.count("*").alias("size")).where("size > 1")
        level = scratch.save(level.join(size, "path"), f"nodes-{d}")
        last = d == DEPTH - 1
        leaves.append(level if last else level.where(F.col("size") <= LEAF))
        if not last:
            large = level.where(F.col("size") > LEAF)
            level = children(large.join(classes.select("cid", "tokens"), "cid"), F.col("path"), d + 1)
    out = leaves[0]
    for leaf in leaves[1:]:
        out = out.union(leaf)
    return out.select("path", "cid", "n", "size", "tree", "turns")


def _first_meeting(trees: int, met: Column) -> Column:
    """Whether a pair's node is the first in which it must meet, so that it is compared once.

    ``met`` tells at which positions two classes share a token. A pair that shares one at every level of a tree
    meets in a leaf of that tree, on the path of its first shared tokens. It is compared there in the first such tree,
    and in earlier trees, where it meets only in leaves that end above the last level.
    """
    equal = lambda tree, level, j: F.get(met, tree * (DEPTH * BRANCH) + level * BRANCH + j)
    meets = lambda t: reduce(and_, (reduce(or_, (equal(F.lit(t), d, j) for j in range(BRANCH))) for d in range(DEPTH)))
    first = F.coalesce(*(F.when(meets(t), t) for t in range(trees)), F.lit(trees))
    earlier = [F.coalesce(F.get("turns", F.lit(d)), F.lit(0)) <= F.least(*(F.when(equal(F.col("tree"), d, j), j).otherwise(BRANCH) for j in range(BRANCH))) for d in range(DEPTH)]
    return (F.col("tree") < first) | ((F.col("tree") == first) & reduce(and_, earlier))


def near_duplicates(docs: DataFrame, similar_pct: int = 80, screened: bool = True) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no shingles, link with nothing and are their own component. Rows without an
    id can be linked, but never name a component, and are not kept. Repeated rows and ids share a component
    through equal sets; other columns are ignored. Texts of any length are read whole. An empty table gives an empty one.
    """
    out = _placed(docs, Scratch(docs.sparkSession, "near"), similar_pct, screened).withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _placed(docs: DataFrame, scratch: Scratch, similar_pct: int, screened: bool) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component)`` of every row; the component is null for texts without words."""
    trees = trees_for(similar_pct / 100)
    k = max(SCREEN, trees * DEPTH * BRANCH)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    rows = scratch.save(
        source.mapInArrow(_sketches(k), "doc_id long, text_key long, n_shingles long, set_key binary, tokens array<int>"), "rows"
    )
    classes = (
        rows.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("tokens").alias("tokens"), F.first("n_shingles").alias("n"))
        .select("set_key", "first.doc_id", "first.text_key", "tokens", "n", F.monotonically_increasing_id().alias("cid"))
    )
    classes = scratch.save(classes, "classes")
    leaves = _nodes(scratch, classes.select("cid", "tokens", "n"), trees)

    leaves = scratch.save(leaves.join(classes.select("cid", "tokens"), "cid"), "leaves")
    s = similar_pct / 100
    least = math.floor(k * s - 4.5 * math.sqrt(k * s * (1 - s))) if screened else 0
    met = F.zip_with("tokens_a", "tokens_b", lambda x, y: x == y)
    sized = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * similar_pct
    likely = F.size(F.filter(met, lambda x: x)) >= least
    pair = (F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b"))

    # small nodes: every pair that the tokens let through
    few = leaves.where(F.col("size") <= LEAF)
    sides = ("cid", "n", "tokens")
    left = few.select("path", "tree", "turns", *(F.col(c).alias(f"{c}_a") for c in sides))
    right = few.select(F.col("path").alias("path_b"), *(F.col(c).alias(f"{c}_b") for c in sides))
    near = left.join(right, (F.col("path") == F.col("path_b")) & (F.col("cid_a") < F.col("cid_b")) & sized & likely & _first_meeting(trees, met)).select(*pair)

    # large nodes: the leaders are the first class and another at random
    many = leaves.where(F.col("size") > LEAF)
    member = F.struct("cid", "n")
    leaders = many.groupBy("path").agg(F.min(member).alias("first"), F.min_by(member, F.xxhash64("cid", "path")).alias("other"))
    leaders = leaders.select("path", F.explode(F.array_distinct(F.array("first", "other"))).alias("l"))
    leaders = leaders.join(many.select("path", "cid", "tokens"), ["path"]).where("cid = l.cid").select("path", F.col("cid").alias("cid_b"), F.col("l.n").alias("n_b"), F.col("tokens").alias("tokens_b"))
    leaders = scratch.save(leaders, "leaders")  # read again it has no partitioning of its own, and Spark can split a large node
    stars = many.select("path", *(F.col(c).alias(f"{c}_a") for c in sides)).join(leaders, "path").where((F.col("cid_a") != F.col("cid_b")) & sized & likely).select(*pair)
    first_pairs = scratch.save(near.union(stars).distinct(), "pairs")

    need = first_pairs.select(F.explode(F.array("a", "b")).alias("cid")).union(many.select("cid")).distinct().join(classes.select("cid", "doc_id", "text_key"), "cid")
    texts = source.join(need, ["doc_id", "text_key"]).groupBy("doc_id", "text_key", "cid").agg(F.first("text").alias("text")).select("cid", "text")
    texts = scratch.save(texts, "texts")
    first = _links(scratch, texts, first_pairs, similar_pct, "first")

    known = components(scratch, first, "c1")
    placed = many.select("path", "cid").join(known.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    placed = scratch.save(placed, "rooted")
    open_nodes = scratch.save(placed.groupBy("path").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("path"), "open")
    placed = scratch.save(placed.join(open_nodes, "path"), "placed")
    opened = texts.join(placed.select("cid").distinct(), "cid")
    shingles = opened.mapInArrow(_shingle_rows, "cid bigint, shingle bigint")
    single = shingles.groupBy("shingle").agg(F.count("*").alias("c"), F.min("cid").alias("cid")).where("c = 1")
    own = scratch.save(single.groupBy("cid").agg(F.count("*").alias("own")), "own")
    # m, the shingles that others have as well, bounds an intersection; in itself a class needs m of s times its size
    placed = placed.join(many, ["path", "cid"]).join(own, "cid", "left").withColumn("m", F.col("n") - F.coalesce("own", F.lit(0)))
    placed = placed.where(F.col("m") * 100 >= F.col("n") * similar_pct)
    placed = placed.join(scratch.save(opened.mapInArrow(_small_sets, "cid bigint, small array<int>"), "small"), "cid")
    placed = scratch.save(placed, "bounded")
    # the largest component of a node needs no comparison within itself, nor another as its left side
    sizes = placed.groupBy("path", "root").agg(F.count("*").alias("c"))
    largest = sizes.groupBy("path").agg(F.max_by("root", F.struct("c", "root")).alias("largest"), F.ceil(F.sum("c") / BLOCK).cast("int").alias("blocks"))
    dealt = placed.join(scratch.save(largest, "largest"), "path").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sides = ("cid", "n", "m", "root", "tokens", "small")
    left = dealt.where("root <> largest").select("path", F.col("block").alias("one"), F.col("other").alias("two"), "tree", "turns", *(F.col(c).alias(f"{c}_a") for c in sides))
    right = dealt.select("path", F.col("other").alias("one"), F.col("block").alias("two"), *(F.col(c).alias(f"{c}_b") for c in sides))
    bound = F.least("m_a", "m_b") * (100 + similar_pct) >= (F.col("n_a") + F.col("n_b")) * similar_pct
    # folded hashes can only make two sets look more alike
    alike = F.size(F.array_intersect("small_a", "small_b")) * (100 + similar_pct) >= (F.col("n_a") + F.col("n_b")) * similar_pct
    alike = F.col("small_a").isNull() | F.col("small_b").isNull() | alike
    # all of it in the join's condition, so that no other pair leaves the join
    block = (left.path == right.path) & (left.one == right.one) & (left.two == right.two)
    cross = left.join(right, block & (F.col("root_a") != F.col("root_b")) & bound & likely & _first_meeting(trees, met) & alike)
    cross = scratch.save(cross.select(*pair).distinct().join(first_pairs, ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        second = _links(scratch, texts, cross, similar_pct, "second")
        known = components(scratch, first.union(second), "c2")

    found = classes.select("set_key", "doc_id", "cid").join(known.withColumnRenamed("node", "cid"), "cid", "left")
    found = found.withColumn("root", F.coalesce("root", "cid"))
    least_id = found.groupBy("root").agg(F.min("doc_id").alias("component"))
    found = found.join(least_id, "root").select("set_key", "component")
    return rows.join(found, "set_key", "left").select("doc_id", "text_key", "n_shingles", "component")


def _links(scratch: Scratch, texts: DataFrame, pairs: DataFrame, similar_pct: int, name: str) -> DataFrame:
    """Those of ``pairs(a, b)`` whose full sets are similar enough."""
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return scratch.save(joined.mapInArrow(_confirm(similar_pct), "a bigint, b bigint"), f"{name}-links")


def drop_near_duplicates(docs: DataFrame, similar_pct: int = 80) -> DataFrame:
    """``docs`` with one document for each component, that of the least id, then of the least hash of its text.

    A document is a doc_id with a text, so an id that two different texts share stands for both. Of repeated rows the one whose
    other columns (all of orderable types) sort first stays. Rows without an id can't be named as a group's representative and stay;
    texts without words are no copies of each other.
    """
    scratch = Scratch(docs.sparkSession, "near-kept")
    rows = _placed(docs, scratch, similar_pct, True).where("doc_id IS NOT NULL")
    first = rows.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("d")).select("d.*")
    kept = scratch.save(first.union(rows.where("component IS NULL").select("doc_id", "text_key").distinct()), "kept")
    # renamed first, so that no column of the input can clash
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    doc_id, text = names["doc_id"], names["text"]
    own_key = F.xxhash64(text)
    one = own.join(kept, (F.col(doc_id) == F.col("doc_id")) & (own_key == F.col("text_key")), "left_semi")
    rest = [n for n in names.values() if n not in (doc_id, text)]
    one = one.groupBy(doc_id, own_key.alias("own_key")).agg(F.min(F.struct(text, *rest)).alias("r")).select(doc_id, "r.*")
    out = one.select(*names.values()).unionByName(own.where(F.col(doc_id).isNull()))
    return out.select(*(F.col(n).alias(c) for c, n in names.items()))
