"""Line dedup by a log-template tree.

A line falls through a tree: first by its number of tokens, then by its leading tokens, where a token
with a digit stands for any such token. In a leaf that several documents reach, the ``FULL`` commonest distinct lines are clustered into templates, commonest first: a line that is
like no earlier template becomes one. Every line of the leaf belongs to the first template that has a large enough share of its tokens; lines that are like none go on to leaves by twice
as many leading tokens, where the same is done, until what is left in a leaf is one document's. So the depth follows from the tokens of the longest line, not from the number of lines, and no leaf has more than
``FULL`` templates. Positions where a template's lines differ are its variable fields; a line of its leaf that has all of its constants belongs to it too, if these are a large enough part and
no earlier template has the line. A template whose lines occur
in several documents is boilerplate: its lines are dropped from all of these documents but the first, so that a text that was copied whole
keeps one home. Two documents are several, but lines of fewer than ``SHORT`` tokens need ``MIN_DOCS``.
A document of which nothing would be left is a copy as a whole: its lines go if ``MIN_DOCS`` documents or more have them, and else
stay for the near-duplicate operator.

All of it is DataFrame operations. The first pass over the texts reads no more of a line than its number of blanks and its
leading tokens; only lines of leaves that recur are read whole, and only leaves of several distinct lines are clustered. A leaf's commonest lines
are picked ahead of the shuffle, and its lines meet its templates in shares of ``SHARE`` lines, so no task holds a large leaf.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellwatch.llm.scratch import Scratch

#: Leading tokens that the tree branches by first; each further level branches by twice as many.
LEAD = 4
#: Lines of fewer tokens need ``MIN_DOCS`` documents.
SHORT = 3
#: Percentage of a line's tokens that must be the template's.
SIMILAR_PCT = 70
#: Percentage of a template's tokens that must be constants for these alone to decide.
CONSTANT_PCT = 50
#: Distinct lines of a leaf, commonest first, among which templates are looked for before the rest goes a level deeper.
FULL = 128
#: Distinct lines of a leaf that one task compares with its templates. Only the work depends on it.
SHARE = 4096
#: Documents in which a template's lines must occur for a document to lose its last words, or short lines.
MIN_DOCS = 4
#: Documents in which a template's lines must occur otherwise.
LEAST_DOCS = 2
#: Up to so many leaves or lines (16 bytes each) are sent to all executors; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: A token with a digit. It begins behind a blank and never gives back, so the search is linear.
_WITH_DIGIT = "(?<![^ ])[^ 0-9]*+[0-9][^ ]*"


def _broadcast_if_small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def _masked(line: Column) -> Column:
    """Tokens with a digit become wildcards, unless nothing else would be left."""
    masked = F.regexp_replace(line, _WITH_DIGIT, "<*>")
    return F.when(F.replace(F.replace(masked, F.lit("<*>"), F.lit("")), F.lit(" "), F.lit("")) == "", line).otherwise(masked)


def _lines(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_key, at, line, n, leaf)`` of the lines that have a token, with single blanks between tokens."""
    text = F.col("text")
    blank = F.when(text.contains("\t") | text.contains("\r"), F.translate(text, "\t\r", "  ")).otherwise(text)
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_key"), blank.alias("text"))
    single = F.when(text.contains("  "), F.regexp_replace(text, "  +", " ")).otherwise(text)
    lines = docs.select("doc_id", "text_key", F.posexplode(F.split(single, "\n")).alias("at", "line"))
    lines = lines.select("doc_id", "text_key", "at", F.trim("line").alias("line")).where("line <> ''")
    n = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1
    return lines.withColumn("n", n).withColumn("leaf", F.xxhash64("n", F.regexp_replace(F.substring_index("line", " ", LEAD), _WITH_DIGIT, "<*>")))


def recurring_lines(docs: DataFrame, scratch: Scratch, min_docs: int = LEAST_DOCS, similar_pct: int = SIMILAR_PCT) -> DataFrame:
    """``(doc_id, text_key, at, often)``: for each document with lines to drop, their indexes in ``split(text, '\\n')``, and of these
    the ones that at least ``MIN_DOCS`` documents have."""
    lines = _lines(docs)
    own = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text_key")  # the document
    spread = lines.groupBy("leaf").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    leaves = scratch.save(spread.where("lo <> hi").select("leaf"), "leaves")
    open_lines = lines.join(_broadcast_if_small(leaves), "leaf", "left_semi").withColumn("line", _masked(F.col("line")))
    open_lines = scratch.save(open_lines.withColumn("key", F.xxhash64("line")), "lines")
    lists = open_lines.groupBy("key").agg(F.first("leaf").alias("leaf"), F.first("line").alias("line"), F.count("*").alias("c"), F.min(own).alias("lo"), F.max(own).alias("hi"))
    lists = scratch.save(lists, "lists")
    mixed = lists.groupBy("leaf").agg(F.min("key").alias("a"), F.max("key").alias("b"), _shares()).where("a <> b").select("leaf", "shares")
    mixed = lists.join(_broadcast_if_small(scratch.save(mixed, "mixed")), "leaf").withColumn("tokens", F.split("line", " ")).drop("line")
    found = scratch.save(_clustered(mixed, scratch, similar_pct).where("key <> template"), "members")
    # a line of no other template is its own
    fits = open_lines.select("key", "n", "doc_id", "text_key", "at").join(_broadcast_if_small(found), "key", "left")
    fits = scratch.save(fits.select(F.coalesce("template", "key").alias("template"), "n", "doc_id", "text_key", "at"), "fits")
    homes = fits.select("template", "n", "doc_id", "text_key").distinct()
    homes = homes.groupBy("template", "n").agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "text_key")).alias("home"))
    homes = scratch.save(homes.where(F.col("docs") >= F.when(F.col("n") < SHORT, max(min_docs, MIN_DOCS)).otherwise(min_docs)).drop("n"), "homes")
    dropped = fits.join(homes, "template").where(~F.struct("doc_id", "text_key").eqNullSafe(F.col("home")))
    often = F.collect_list(F.when(F.col("docs") >= MIN_DOCS, F.col("at")))
    return dropped.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_list("at")).alias("at"), F.sort_array(often).alias("often"))


def _same(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))


def _shares() -> Column:
    return F.ceil(F.count("*") / SHARE).cast("int").alias("shares")


def _dealt(leaves: DataFrame) -> DataFrame:
    """Rows of leaves, once for each of their shares."""
    return leaves.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")


def _clustered(rest: DataFrame, scratch: Scratch, similar_pct: int) -> DataFrame:
    """``(key, template)`` of the lines ``rest(leaf, shares, key, tokens, c, lo, hi)`` that belong to a template; a template is known by the key of its first line.

    One round of jobs for each level of the tree, so no more than the binary logarithm of the most tokens in a line; lines of which only one document is left in a leaf need no more.
    """
    with_share = lambda df: df.withColumn("share", F.pmod("key", F.col("shares")).cast("int"))
    rest = scratch.save(with_share(rest), "rest-0")
    like = lambda a, b: _same(a, b) * 100 >= F.size(a) * similar_pct
    add = lambda kept, x: F.when(F.exists(kept, lambda k: like(x["tokens"], k["tokens"])), kept).otherwise(F.concat(kept, F.array(x)))
    levels, depth = [], LEAD
    while not rest.isEmpty():
        n = len(levels)
        # Spark drops all but the first FULL of a leaf ahead of the shuffle
        place = F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("c"), "tokens", "key"))
        top = rest.select("leaf", "shares", "c", "tokens", "key").withColumn("place", place).where(F.col("place") <= FULL)
        top = top.groupBy("leaf").agg(F.first("shares").alias("shares"), F.array_sort(F.collect_list(F.struct("place", "tokens", "key"))).alias("top"))
        # of the commonest lines those that are like none before them
        kept = F.aggregate("top", F.array().cast("array<struct<place:int,tokens:array<string>,key:bigint>>"), add)
        top = scratch.save(top.select("leaf", "shares", kept.alias("templates")), f"templates-{n}")
        met = rest.join(_dealt(top), ["leaf", "share"])
        met = met.withColumn("t", F.get(F.filter("templates", lambda k: like(F.col("tokens"), k["tokens"])), F.lit(0))).drop("templates")
        # templates count on from level to level
        met = scratch.save(met.withColumn("ix", F.lit(n * (FULL + 1)) + F.col("t.place")), f"met-{n}")
        levels.append(met)
        depth *= 2
        left = met.where("t IS NULL").select(F.xxhash64("leaf", F.array_join(F.slice("tokens", 1, depth), " ")).alias("leaf"), "key", "tokens", "c", "lo", "hi")
        open_leaves = left.groupBy("leaf").agg(F.min("lo").alias("least"), F.max("hi").alias("most"), _shares()).where("least <> most").select("leaf", "shares")
        rest = scratch.save(with_share(left.join(_broadcast_if_small(scratch.save(open_leaves, f"open-{n}")), "leaf")), f"rest-{n + 1}")
    if not levels:
        return rest.select("key", F.col("key").alias("template"))
    met = functools.reduce(DataFrame.unionByName, levels)
    found = met.where("t IS NOT NULL").select("leaf", "shares", "ix", "key", "tokens", F.col("t.tokens").alias("model"), F.col("t.key").alias("template"))
    # the positions that vary: a line with all other tokens of a template belongs to it, unless it is like an earlier one
    differs = F.filter(F.sequence(F.lit(0), F.size("tokens") - 1), lambda i: F.get("tokens", i) != F.get("model", i))
    varies = found.select("leaf", "shares", "ix", "template", F.explode(differs).alias("i")).groupBy("leaf", "shares", "ix", "template").agg(F.collect_set("i").alias("varies"))
    models = found.where("key = template").select("template", "model")
    varies = varies.join(models, "template").where((F.size("model") - F.size("varies")) * 100 >= F.size("model") * CONSTANT_PCT)
    field = F.transform("model", lambda x, i: F.when(~F.array_contains("varies", i), x))
    fields = varies.groupBy("leaf", "shares").agg(F.array_sort(F.collect_list(F.struct("ix", "template", field.alias("field")))).alias("fields"))
    fields = scratch.save(fields, "fields")
    constant = lambda f: F.forall(F.zip_with(f["field"], "tokens", lambda x, y: x.isNull() | (x == y)), lambda x: x)
    late = met.join(_dealt(fields), ["leaf", "share"]).select("key", F.get(F.filter("fields", constant), F.lit(0)).alias("f")).where("f IS NOT NULL")
    first = found.select("key", "ix", "template").union(late.select("key", "f.ix", "f.template"))
    return first.groupBy("key").agg(F.min_by("template", "ix").alias("template"))


def drop_recurring_lines(docs: DataFrame, scratch: Scratch | None = None, min_docs: int = LEAST_DOCS, similar_pct: int = SIMILAR_PCT) -> DataFrame:
    """``docs`` with the recurring lines taken out of ``text``, and ``n_lines`` and ``n_dropped`` (long) added.

    A document is a doc_id with a text: repeated rows are one document and get the same text. The first document of a template
    is that of the least doc_id, nulls first, then of the least hash of its text. Null texts stay null, with no lines; blank
    lines stay, and so do lines of fewer than ``MIN_DOCS`` documents where a document has no other word. Of lines that are equally common the one
    whose tokens sort first is clustered first. Texts of any length are read whole; an empty table gives an empty one.
    Other columns pass through, but for those of the two added names, which are replaced.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    # renamed first, so that no column of the input can clash with the join's own
    names = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in ("n_lines", "n_dropped")}
    own = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    doc_id, text = names["doc_id"], names["text"]
    found = scratch.save(recurring_lines(docs.select("doc_id", "text"), scratch, min_docs, similar_pct), "dropped")
    own = own.withColumn("own_key", F.xxhash64(text))
    out = own.join(found, F.col(doc_id).eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key")), "left")
    lines = F.split(text, "\n")
    without = lambda at: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at), lambda i: F.get(lines, i)), "\n")
    out = out.withColumn("rest", F.when(F.col("at").isNotNull(), without("at")))
    out = out.withColumn("last", F.coalesce(~F.col("rest").rlike("\\S"), F.lit(False)))
    out = out.withColumn("rest", F.when(F.col("last"), without("often")).otherwise(F.col("rest"))).withColumn("n_dropped", F.size(F.when(F.col("last"), F.col("often")).otherwise(F.col("at"))))
    kept = {text: F.coalesce("rest", text)}
    return out.select(
        *(kept.get(n, F.col(n)).alias(c) for c, n in names.items()),
        F.when(F.col(text).isNull(), 0).otherwise(F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.greatest(F.coalesce("n_dropped", F.lit(0)), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def line_report(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text_md5)`` of every row."""
    return drop_recurring_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


_ALIKE = "100 * len([j FOR j IN range(1, len({0}) + 1) IF {0}[j] = {1}[j]]) >= " + f"{SIMILAR_PCT} * len({{0}})"
#: One level of the tree over ``s(r, node, leaf, tokens, c)``: ``n`` is the place of the line's template among its node's, null where it has none.
_LEVEL = f"""
q AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY c DESC, tokens) AS place FROM s),
t AS (SELECT node, list_reduce(list([tokens] ORDER BY place), lambda got, x: CASE WHEN len([m FOR m IN got IF {_ALIKE.format('m', 'x[1]')}]) > 0 THEN got ELSE list_concat(got, x) END) AS leaders FROM q WHERE place <= {FULL} GROUP BY node),
u AS (SELECT q.r, q.node, q.leaf, q.tokens, q.c, t.leaders, [i FOR i IN range(1, len(t.leaders) + 1) IF {_ALIKE.format('q.tokens', 't.leaders[i]')}][1] AS n FROM q JOIN t ON t.node = q.node)
SELECT r, node, leaf, tokens, c, n, leaders[n] AS model FROM u
"""
LINES_SQL = f"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, text, md5(text) AS text_key FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, text_key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ix FROM d),
w0 AS (SELECT doc_id, text_key, ix, trim(regexp_replace(translate(line, chr(9) || chr(13), '  '), ' +', ' ', 'g'), ' ') AS line FROM l),
k AS (SELECT doc_id, text_key, ix, line, string_split(line, ' ') AS raw, [CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END FOR x IN string_split(line, ' ')] AS masked FROM w0 WHERE line <> ''),
lt AS (SELECT doc_id, text_key, ix, md5(len(raw) || ' ' || array_to_string(masked[1:{LEAD}], ' ')) AS leaf, CASE WHEN len([x FOR x IN masked IF x <> '<*>']) = 0 THEN raw ELSE masked END AS tokens FROM k),
lr AS (SELECT leaf FROM (SELECT DISTINCT leaf, doc_id, text_key FROM lt) GROUP BY leaf HAVING count(*) >= {LEAST_DOCS}),
o AS (SELECT lt.* FROM lt JOIN lr USING (leaf)),
g AS (WITH s AS (SELECT 0 AS r, leaf AS node, leaf, tokens, count(*) AS c FROM o GROUP BY leaf, tokens), {_LEVEL}
      UNION ALL (WITH s AS (SELECT r + 1 AS r, md5(node || ' ' || array_to_string(tokens[1:{LEAD} * CAST(pow(2, r + 1) AS INTEGER)], ' ')) AS node, leaf, tokens, c FROM g WHERE n IS NULL), {_LEVEL})),
v AS (SELECT r, node, n, model, list(DISTINCT j) AS varies FROM (SELECT r, node, n, model, unnest([j FOR j IN range(1, len(tokens) + 1) IF tokens[j] <> model[j]]) AS j FROM g WHERE n IS NOT NULL) GROUP BY r, node, n, model),
f AS (SELECT * FROM v WHERE 100 * (len(model) - len(varies)) >= {CONSTANT_PCT} * len(model)),
y AS (SELECT leaf, tokens, r, node, n FROM g WHERE n IS NOT NULL
      UNION ALL SELECT g.leaf, g.tokens, f.r, f.node, f.n FROM g JOIN f ON f.r = g.r AND f.node = g.node AND len([j FOR j IN range(1, len(g.tokens) + 1) IF g.tokens[j] <> f.model[j] AND NOT list_contains(f.varies, j)]) = 0),
b AS (SELECT leaf, tokens, arg_min(node, r * 1000 + n) AS node, min(r * 1000 + n) AS n FROM y GROUP BY leaf, tokens),
p AS (SELECT b.node, b.n, o.doc_id, o.text_key, o.ix, len(o.tokens) AS size FROM o JOIN b ON b.leaf = o.leaf AND b.tokens = o.tokens),
w AS (SELECT node, n, min(doc_id) AS home, count(*) AS docs FROM (SELECT DISTINCT node, n, doc_id, text_key, size FROM p) GROUP BY node, n, size HAVING count(*) >= CASE WHEN size < {SHORT} THEN {MIN_DOCS} ELSE {LEAST_DOCS} END),
x AS (SELECT p.doc_id, p.text_key, list(p.ix) AS ix, coalesce(list(p.ix) FILTER (WHERE docs >= {MIN_DOCS}), []) AS often FROM p JOIN w ON w.node = p.node AND w.n = p.n WHERE p.doc_id <> w.home GROUP BY p.doc_id, p.text_key),
e AS (SELECT m.doc_id, CASE WHEN m.text IS NULL THEN [] ELSE string_split(m.text, chr(10)) END AS lines, m.text, x.ix, x.often FROM documents m LEFT JOIN x ON m.doc_id = x.doc_id AND md5(m.text) = x.text_key),
z AS (SELECT *, CASE WHEN ix IS NOT NULL AND NOT regexp_matches(coalesce(array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(ix, i)], chr(10)), ''), '\\S') THEN often ELSE ix END AS gone FROM e)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       md5(CASE WHEN gone IS NULL THEN text ELSE coalesce(array_to_string([lines[i] FOR i IN range(1, len(lines) + 1) IF NOT list_contains(gone, i)], chr(10)), '') END) AS text_md5
FROM z
"""
