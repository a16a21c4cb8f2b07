"""Chat formatting after cumulative-snapshot collapse.

A log often holds a conversation many times, each snapshot a turn longer. Every turn gets the rolling hash of the
conversation up to it; a conversation whose last hash is another one's hash at the same number of turns is a
prefix of it, and an anti-join leaves the maximal ones, which are then rendered turn by turn.

The rolling hash is a sum of hashes of (position, role, text), so it can be added up in parts: turns are dealt by
conversation and range of turn numbers, and the parts' sums are put in front. No task holds a whole conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellwatch.llm.scratch import Scratch

#: Turn numbers in one part of a conversation.
PART = 512
_NO_TURN = -(1 << 40)


def _digest() -> Column:
    """Tells roles and texts apart, nulls from empty ones as well."""
    told = [F.concat(F.when(F.col(c).isNull(), "n").otherwise("v"), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("role", "text")]
    return F.md5(F.concat_ws("\n", *[F.md5(t) for t in told]))


def _before(parts: DataFrame, *sums: str) -> DataFrame:
    """For each part of a conversation the sums over its earlier parts."""
    w = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select("conv_id", "part", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}_before") for c in sums))


def turn_hashes(turns: DataFrame) -> DataFrame:
    """``(conv_id, turn, digest, position, h1, h2)``: distinct turns in order, with the rolling hashes up to each."""
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", _digest().alias("digest")).distinct()
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / PART).cast("bigint"), F.lit(_NO_TURN)))
    order = Window.partitionBy("conv_id", "part").orderBy("turn", "digest")
    rows = rows.withColumn("rank", F.row_number().over(order))
    counts = rows.groupBy("conv_id", "part").agg(F.max("rank").cast("bigint").alias("n"))
    rows = rows.join(_before(counts, "n"), ["conv_id", "part"]).withColumn("position", (F.col("rank") + F.col("n_before")).cast("bigint"))
    for k in (1, 2):
        rows = rows.withColumn(f"x{k}", F.xxhash64(F.lit(k), "position", "digest").cast("decimal(20,0)"))
    sums = rows.groupBy("conv_id", "part").agg(F.sum("x1").alias("s1"), F.sum("x2").alias("s2"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(_before(sums, "s1", "s2"), ["conv_id", "part"])
    for k in (1, 2):
        rows = rows.withColumn(f"h{k}", (F.sum(f"x{k}").over(running) + F.col(f"s{k}_before")).cast("decimal(38,0)"))
    return rows.select("conv_id", "turn", "digest", "position", "h1", "h2")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """``(conv_id, n_turns)`` of the conversations that are no prefix of another; of equal ones the least id."""
    last = hashed.groupBy("conv_id").agg(F.max("position").alias("n_turns"))
    at = hashed.join(last, "conv_id")
    whole = at.where("position = n_turns").groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"))
    inner = at.where("position < n_turns").select("h1", "h2", F.col("position").alias("n_turns")).distinct()
    return whole.join(inner, ["h1", "h2", "n_turns"], "left_anti").select("conv_id", "n_turns")


def render(role: Column, text: Column) -> Column:
    """One turn in chat markup; a null role or text is empty."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("<|im_start|>"), empty(role), F.lit("\n"), empty(text), F.lit("<|im_end|>\n"))


def render_conversations(turns: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``(conv_id, position, n_turns, segment)``: the turns of the maximal conversations, rendered; their segments by position,
    put together, are the conversation's text.

    Reads ``turns(conv_id, turn, role, text, ...)``. Turns go by turn number, nulls first, then by a digest of role and
    text; repeated rows are one turn. Rows without a conv_id belong to no conversation and give no rows. Null and empty
    roles and texts are told apart when conversations are compared. Other columns are ignored.
    """
    scratch = scratch or Scratch(turns.sparkSession, "snapshots")
    hashed = scratch.save(turn_hashes(turns), "hashes")
    kept = scratch.save(maximal_conversations(hashed), "maximal")
    places = hashed.select("conv_id", "turn", "digest", "position").join(kept, "conv_id")
    texts = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text", _digest().alias("digest"))
    texts = texts.join(kept.select("conv_id"), "conv_id", "left_semi")
    texts = texts.groupBy("conv_id", "turn", "digest").agg(F.first(F.struct("role", "text")).alias("said"))
    same = (F.col("p.conv_id") == F.col("t.conv_id")) & F.col("p.turn").eqNullSafe(F.col("t.turn")) & (F.col("p.digest") == F.col("t.digest"))
    out = places.alias("p").join(texts.alias("t"), same)
    return out.select("p.conv_id", "p.position", "p.n_turns", render(F.col("t.said.role"), F.col("t.said.text")).alias("segment"))


_TOLD = "(CASE WHEN {0} IS NULL THEN 'n' ELSE 'v' END) || coalesce({0}, '')"
RENDER_SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text, md5(md5({_TOLD.format('role')}) || chr(10) || md5({_TOLD.format('text')})) AS digest FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns FROM t),
p AS (SELECT *, string_agg(digest, ',') OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix FROM o),
w AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE position = n_turns GROUP BY prefix),
kept AS (SELECT conv_id FROM w WHERE prefix NOT IN (SELECT prefix FROM p WHERE position < n_turns))
SELECT conv_id, position, n_turns, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS segment
FROM o WHERE conv_id IN (SELECT conv_id FROM kept)
"""
