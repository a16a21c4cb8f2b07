"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned into the axes of their principal components, largest first; a turn keeps every
cosine. A tile multiplies two blocks of vectors a few leading components at a time: the product so far plus the
product of the remaining norms bounds the cosine, and pairs whose bound falls below the threshold get no more work.
Blocks are cut by bins of the leading components: where two vectors' cosine is c, no coordinate differs by more than
sqrt(2 - 2c), so with bins of that width only neighbouring bins meet. A bin of many vectors is dealt into blocks
of at most ``BLOCK`` on average, and each pair of blocks is a tile of its own, so no task's work grows with a bin.

Equal vectors of a label are one row with a count. A tile sends back link counts and, instead of links, the least
member that each of its rows is connected with, so its output is in proportion to its rows.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cellwatch.llm.components import components
from cellwatch.llm.scratch import Scratch

BLOCK = 2048
#: At most so many leading components cut bins.
MAX_BINS = 4
#: Components in a step of a tile.
STEP = 16
#: Cosines nearer to the threshold than this are computed again from the vectors as given.
NEAR = 1e-9
#: Cells of the sums that the driver gets for the principal axes (32 MB), and that it sends to every executor.
AXES_CELLS = 1 << 22


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors as rows, each by a power of two so that its largest component is about 1: no norm or product can overflow or vanish, and
    cosines of vectors of usual size stay the same to the last bit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def _moments(batches):
    """Sums for the covariance of unit vectors: one row per partition and dimension."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        by_size: dict[int, list] = {}
        for v in batch.column("v").to_pylist():
            by_size.setdefault(len(v), []).append(v)
        for d, rows in by_size.items():
            x = _unit(np.asarray(rows, np.float64))
            total[d] = total.get(d, 0) + x.T @ x
    rows = [(d, i, m[i].tolist()) for d, m in total.items() for i in range(d)]
    yield pa.RecordBatch.from_pydict({"d": [r[0] for r in rows], "i": [r[1] for r in rows], "row": [r[2] for r in rows]}, pa.schema([("d", pa.int32()), ("i", pa.int32()), ("row", pa.list_(pa.float64()))]))


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Axes by dimension, as columns, largest share first. Only d x d sums over all vectors reach the driver, for the commonest
    dimensions, ``AXES_CELLS`` sums in all at most; vectors of other dimensions keep the axes that they have, which changes work but no result."""
    sizes = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).where(F.col("d") * F.col("d") <= AXES_CELLS).orderBy(F.desc("n"), "d").limit(1000).collect()
    chosen, cells = [], 0
    for r in sizes:
        if cells + r["d"] ** 2 <= AXES_CELLS:
            chosen.append(r["d"])
            cells += r["d"] ** 2
    sums = vectors.where(F.size("v").isin(chosen)).select("v").mapInArrow(_moments, "d int, i int, row array<double>").select("d", "i", F.posexplode("row").alias("j", "x"))
    cells = sums.groupBy("d", "i", "j").agg(F.sum("x").alias("x")).toPandas()
    axes = {}
    for d, part in cells.groupby("d"):
        m = np.zeros((d, d))
        m[part["i"], part["j"]] = part["x"]
        axes[int(d)] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return axes


def _turned(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    x = _unit(x)
    return x @ axes[x.shape[-1]] if x.shape[-1] in axes else x


def _turn(shared, width: float, bins: int):
    def run(batches):
        for batch in batches:
            cells = [np.floor(_turned(np.asarray(v, np.float64), shared.value)[:bins] / width).astype(int).tolist() for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cid", "label", "copies", "v")), pa.array(cells, pa.list_(pa.int32()))], ["cid", "label", "copies", "v", "cell"])

    return run


def linked(a: np.ndarray, b: np.ndarray, va: list, vb: list, threshold: float, step: int = STEP) -> np.ndarray:
    """Which rows of two turned blocks have a cosine of the threshold at least, as a matrix."""
    d = a.shape[1]
    left = lambda x: np.sqrt(np.maximum(0, np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]))
    ra, rb = left(a), left(b)
    at = min(step, d)
    got = a[:, :at] @ b[:, :at].T
    out = np.zeros(got.shape, bool)
    bound = got + np.multiply.outer(ra[:, at], rb[:, at]) if at < d else got
    i, j = np.nonzero(bound >= threshold - NEAR)
    got = got[i, j]
    while at < d and len(i):
        to = min(at + step, d)
        more = np.empty(len(i))
        for lo in range(0, len(i), 1 << 18):  # bounds the gathered rows
            s = slice(lo, lo + (1 << 18))
            more[s] = np.einsum("ij,ij->i", a[i[s], at:to], b[j[s], at:to])
        got = got + more
        at = to
        live = (got + ra[i, at] * rb[j, at] if at < d else got) >= threshold - NEAR
        i, j, got = i[live], j[live], got[live]
    for k in np.flatnonzero(np.abs(got - threshold) <= NEAR):
        x, y = scaled(np.asarray(va[i[k]], np.float64)), scaled(np.asarray(vb[j[k]], np.float64))
        got[k] = float(x @ y) / (float(np.sqrt(x @ x)) * float(np.sqrt(y @ y)))
    keep = got >= threshold
    out[i[keep], j[keep]] = True
    return out


def _tile(threshold: float, shared):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in rows.groupby(rows["v"].map(len)):
            part = part.sort_values("cid")
            one, two = part[part["side"] != 2], part[part["side"] != 1]
            if not len(one) or not len(two):
                continue
            within = bool((part["side"] == 0).any())  # a block against itself
            a, b = (_turned(np.stack(x["v"]).astype(np.float64), shared.value) for x in (one, two))
            link = linked(a, b, list(one["v"]), list(two["v"]), threshold)
            if within:
                np.fill_diagonal(link, False)
            a, b = one["cid"].to_numpy(), two["cid"].to_numpy()
            na = link @ two["copies"].to_numpy()
            # the least member each row is connected with inside the tile
            la, lb = a.copy(), b.copy()
            i, j = np.nonzero(link)
            while len(i):
                ma, mb = la.copy(), lb.copy()
                np.minimum.at(ma, i, lb[j])
                np.minimum.at(mb, j, ma[i])
                if within:
                    ma = mb = np.minimum(ma, mb)
                if (ma == la).all() and (mb == lb).all():
                    break
                la, lb = ma, mb
            out.append(pd.DataFrame({"cid": a, "links": na, "to": la}))
            if not within:
                out.append(pd.DataFrame({"cid": b, "links": one["copies"].to_numpy() @ link, "to": lb}))
        out = pd.concat(out) if out else pd.DataFrame({"cid": [], "links": [], "to": []})
        return out[(out["links"] > 0) | (out["to"] != out["cid"])].astype("int64")

    return run


def _tiles(cells: DataFrame, bins: int) -> DataFrame:
    """``(tile, label, cell, block, side)``: each pair of blocks in one cell or in neighbouring cells, once."""
    steps = [s for s in itertools.product((-1, 0, 1), repeat=bins) if s >= (0,) * bins]
    near = F.explode(F.array(*(F.array(*(F.get("cell", F.lit(i)) + F.lit(x) for i, x in enumerate(s))) for s in steps)))
    pairs = cells.select("label", F.col("cell").alias("cell_a"), F.col("blocks").alias("n_a"), near.alias("cell_b"))
    pairs = pairs.join(cells.select("label", F.col("cell").alias("cell_b"), F.col("blocks").alias("n_b")), ["label", "cell_b"])
    pairs = pairs.withColumn("a", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1))).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)))
    same = F.col("cell_a") == F.col("cell_b")
    pairs = pairs.where(~same | (F.col("a") <= F.col("b"))).withColumn("tile", F.struct("label", "cell_a", "a", "cell_b", "b"))
    own = same & (F.col("a") == F.col("b"))
    first = pairs.select("tile", "label", F.col("cell_a").alias("cell"), F.col("a").alias("block"), F.when(own, 0).otherwise(1).alias("side"))
    second = pairs.where(~own).select("tile", "label", F.col("cell_b").alias("cell"), F.col("b").alias("block"), F.lit(2).alias("side"))
    return first.union(second)


def near_vectors(rows: DataFrame, threshold: float = 0.8, bins: int | None = None, block: int = BLOCK) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``rows(vec_id, embedding, label, ...)``.

    Vectors are linked when their labels are equal and their cosine in double precision is ``threshold`` at least. Null
    labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing; vectors of
    different lengths are not linked. Components may be as small or large as doubles are: a vector is scaled by a power of two before its norm is taken,
    so parallel vectors have a cosine of 1 at any scale. Repeated rows are vectors of their own and link with each other. A row without an
    id counts as a link but never names a component and is not kept. Other columns are ignored; no rows give none.
    ``bins``, the leading components that cut bins, follows from the number of vectors where it is not given; it
    changes the work, not the result.
    """
    scratch = Scratch(rows.sparkSession, "cosine")
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("v"))
    usable = F.expr("label IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND abs(x) < double('infinity') AND NOT isnan(x)) AND exists(v, x -> x <> 0)")
    rows = rows.withColumn("v", F.when(F.coalesce(usable, F.lit(False)), F.transform("v", lambda x: x + 0.0)))
    # a hash of the vector finds equal ones; -0.0 counts as 0.0
    rows = scratch.save(rows.withColumn("key", F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.struct("v")), 256))), "rows")
    groups = rows.where("v IS NOT NULL").groupBy("label", "key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    groups = scratch.save(groups.withColumn("cid", F.monotonically_increasing_id()), "groups")
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    if bins is None:
        size = groups.agg(F.count("*").alias("n"), F.approx_count_distinct("label").alias("labels")).first()
        fill = max(1.0, size["n"] / max(1, size["labels"]) / block)
        bins = min(MAX_BINS, max(1, math.ceil(math.log(fill) / math.log(1 + 1 / width))))
    shared = rows.sparkSession.sparkContext.broadcast(principal_axes(groups))  # AXES_CELLS at most
    turned = groups.select("cid", "label", "copies", "v").mapInArrow(
        _turn(shared, width, bins), f"cid bigint, label {rows.schema['label'].dataType.simpleString()}, copies bigint, v array<double>, cell array<int>"
    )
    turned = turned.withColumn("cell", F.concat("cell", F.array_repeat(F.lit(0), F.lit(bins) - F.size("cell"))))
    cells = turned.groupBy("label", "cell").agg(F.count("*").alias("n"))
    cells = scratch.save(cells.select("label", "cell", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "cells")
    placed = turned.join(cells, ["label", "cell"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = placed.join(_tiles(cells, bins), ["label", "cell", "block"]).select("tile", "side", "cid", "copies", "v")
    found = scratch.save(dealt.groupBy("tile").applyInPandas(_tile(threshold, shared), "cid bigint, links bigint, to bigint"), "found")
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = components(scratch, found.select(F.col("cid").alias("a"), F.col("to").alias("b")), "c")
    placed = groups.join(known.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = placed.groupBy("root").agg(F.min("least").alias("component"))
    result = placed.join(least, "root").join(counts, "cid", "left").select("label", "key", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(result, ["label", "key"], "left").withColumn("component_id", F.coalesce("component", "vec_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), "component_id", kept.alias("kept"))
