"""Operators against brute force, with the odd rows that every one of them must take."""

import base64
import hashlib
import io
import itertools
import os
import random
import re

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

from cellwatch.llm import bpe, line_templates, near_dedup, ordinal_quality, pii, snapshots, tiled_cosine, toxicity, warc, winnow
from cellwatch.llm.components import components
from cellwatch.llm.scratch import Scratch

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG = "lorem ipsum dolor " * 4000
ODD = [(1, None), (2, ""), (3, LONG), (4, "one two three four five six"), (4, "one two three four five six"), (5, "Two words"), (None, "one two three four five six"), (6, " \n\t "), (7, "x" * 30000)]
SCHEMA = "doc_id bigint, text string"
#: Names that the operators use within.
CLASHES = ["cid", "path", "row_key", "text_key", "score", "at", "root", "kept", "n_lines", "label", "bad_id", "bad_text", "prints", "c0"]


def docs_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


def duckdb_rows(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    return sorted(con.sql(f"SELECT doc_id, n_lines, n_dropped, text_md5 FROM ({sql})").fetchall())


def empty(spark):
    return docs_of(spark, ODD).limit(0)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(100, i) for i in range(101, 140)]
    links = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(Scratch(spark, "t"), links, "c").collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and len(set(got.values())) == 2
    assert components(Scratch(spark, "t"), links.limit(0), "c").count() == 0


# --- personal data

def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda x: re.sub("[^0-9]", "", x)
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_base_spans_equal_the_plain_rules():
    random.seed(1)
    for _ in range(20000):
        t = "".join(random.choice("a@.-+ 1(2)b9%0é") for _ in range(random.randint(1, 40)))
        assert pii.base_spans(t) == plain_spans(t), t
    for t in ("a" * 10**5, "1" * 10**5, "(" * 10**5, "@" * 10**5, "+1" + "(" * 10**5):
        pii.candidates(t, pii.base_spans(t))


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"word{i % 7} staff contact: user{i}@mail.example.org then rest") for i in range(30)] + [(100, "other staff contact: EMP-00417 then rest"), (101, "nothing 12345678 here"), (102, None)]
    got = {r.doc_id: r for r in pii.personal_data_report(docs_of(spark, rows)).collect()}
    assert got[0].n_email == 1 and got[100].spans.startswith("email:21:") and got[100].n_email == 0 and got[101].spans == ""
    assert got[102].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_secrets_and_new_identifiers_seed_the_next_round(spark):
    secret = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f"{'abcdefgh'[i % 8]}{i} key = '{secret(i)}' and on") for i in range(40)] + [(50, "key = 'plain-12345' and on"), (51, f"the digest {secret(51)} stands alone")]
    # emails vouch for "mail me:", its members' ids for "user", where no email ever is
    rows += [(100 + i, f"please mail me: u{i}@x{i}.example.org today") for i in range(20)] + [(200 + i, f"please mail me: ID-{i:03d} today") for i in range(4)] + [(300 + i, f"known user ID-{i:03d} seen") for i in range(4)] + [(310, "known user ID-777 seen")]
    by = {r.doc_id: r.spans for r in pii.personal_data_report(docs_of(spark, rows)).collect()}
    assert by[50].startswith("secret:7:18") and by[51] == "" and sum("secret" in by[i] for i in range(40)) == 40
    assert by[200] == "email:16:22" and by[310] == "email:11:17"


def plain_patterns(found, rounds):
    edges = {}
    for kind, instance, context in found:
        edges[context, instance] = max(kind, edges.get((context, instance), -1))
    need = {k: pii.least_seeds(len({i for (_, i), own in edges.items() if own == k})) for k in range(5)}
    known = {e: k for e, k in edges.items() if k >= 0}
    for k in range(rounds):
        kept = {}
        for c in {c for c, _ in edges}:
            counts = {}
            for (d, _), kind in known.items():
                if d == c:
                    counts[kind] = counts.get(kind, 0) + 1
            if counts:
                kind = min(counts, key=lambda x: (-counts[x], x))
                precision = counts[kind] / sum(d == c for d, _ in edges)
                if counts[kind] >= need[kind] and precision >= pii.PRECISION:
                    kept[c] = (kind, precision)
        if k + 1 == rounds:
            break
        doubts = {}
        for (c, i), own in edges.items():
            if own < 0 and c in kept:
                doubts[i, kept[c][0]] = doubts.get((i, kept[c][0]), 1) * max(1e-6, 1 - kept[c][1])
        sure = {}
        for (i, kind), d in doubts.items():
            if 1 - d >= pii.PRECISION and (i not in sure or (-d, -kind) > sure[i][0]):
                sure[i] = ((-d, -kind), kind)
        known = {e: own if own >= 0 else sure[e[1]][1] for e, own in edges.items() if own >= 0 or e[1] in sure}
    return {(c, k) for c, (k, _) in kept.items()}


def test_pattern_scores_equal_a_plain_version(spark):
    random.seed(9)
    found = []
    for i in range(900):
        c = random.randrange(25)
        found.append((random.choice([c % 3] * 7 + [-1]) if c < 20 else -1, c % 3 * 1000 + random.randrange(200), f"c{c}"))
    found += [(k, 9000 + 10 * k + i, "tied") for k in (1, 2) for i in range(10)]  # two kinds equally common are half precise each
    df = spark.createDataFrame(found, "kind int, instance bigint, context string")
    for rounds in (1, 2, 3):
        got = {(r.context, r.kind) for r in pii.score_patterns(df, Scratch(spark, "t"), rounds).collect()}
        assert got == plain_patterns(found, rounds) and got
    assert pii.score_patterns(df.limit(0), Scratch(spark, "t")).count() == 0


def test_counts_of_kinds_equal_the_plain_rules(spark):
    texts = ["card 4111 1111 1111 1111, +1 (202) 555-0100 or a@b.cd", "10.0.0.1 and 10.0.0.2 and 10.0.0.3", "+1 (202) 555-0100 then c@d.ef, g@h.ij", "é 4111111111111111 4111-1111-1111-1111 4111 1111 1111 1111", "", None]
    got = {r.doc_id: r for r in pii.personal_data_report(docs_of(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        spans = plain_spans(t or "")
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == kind for _, kind, _ in spans) for k in range(4)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()


def test_pii_takes_odd_rows(spark):
    assert pii.personal_data_report(docs_of(spark, ODD)).count() == len(ODD)
    assert pii.personal_data_report(empty(spark)).count() == 0


# --- conversations

def test_prefixes_collapse(spark):
    say = lambda c, *xs: [(c, i, "user", x) for i, x in enumerate(xs)]
    rows = say(1, "a") + say(2, "a", "b") + say(3, "a", "b", "c") + say(4, "a", "b", "c") + say(5, "a", "x") + say(6, None) + say(7, "") + [(None, 0, "user", "a"), (8, 0, None, "z" * 50000), (8, 0, None, "z" * 50000), (9, None, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("digest", F.lit(1)).withColumn("position", F.lit(2))
    got = snapshots.render_conversations(df).orderBy("conv_id", "position").collect()
    assert sorted({r.conv_id for r in got}) == [3, 5, 6, 7, 8, 9]
    assert "".join(r.segment for r in got if r.conv_id == 3) == "".join(f"<|im_start|>user\n{x}<|im_end|>\n" for x in "abc")
    assert [r.n_turns for r in got if r.conv_id == 8] == [1]
    assert snapshots.render_conversations(df.limit(0)).count() == 0


def test_long_conversation_in_parts(spark):
    rows = [(1, i, "user", str(i)) for i in range(1500)] + [(2, i, "user", str(i)) for i in range(1501)]
    got = snapshots.render_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    assert got.agg(F.min("conv_id"), F.max("position"), F.count("*")).first() == (2, 1501, 1501)


# --- archives

def test_archive_round_trip(spark):
    rows = [(1, "u", "same"), (2, "v", "same"), (3, "w", None), (4, None, ""), (5, "a\r\nb", "WARC/1.1\r\n" + LONG), (None, "x", "same"), (2, "v", "same")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1)).withColumn("sha1", F.lit(2))
    got = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in warc.archived_pages(pages).collect())
    same, none = warc.digest(b"same"), warc.digest(b"")
    assert [g[:3] for g in got] == [(0, "revisit", 2), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None)]
    assert got[0][3:] == (4, same) and got[4][3:] == (0, none) and got[6][3] == len(LONG) + 10
    assert warc.archived_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize("gzip", [False, True])
def test_salvage(gzip):
    records = [warc.record(i, f"u{i}", b"payload %d " % i * 50, None, False, "d") for i in range(6)]
    parts = [warc.member(r) if gzip else r for r in records]
    broken = bytearray(parts[2])
    broken[len(broken) // 2] ^= 0xFF
    cut = parts[4][:60]
    blob = b"".join([b"junk", parts[0], parts[1], bytes(broken), parts[3], cut, parts[5]])
    told = list(warc.salvage(io.BytesIO(blob), len(blob)))
    assert [t[2].head["warc-record-id"][12:-1] for t in told if t[2]] == ["0", "1", "3", "5"]
    gaps = [(a, b) for a, b, got, _ in told if got is None]
    assert [b - a for a, b in gaps] == [4, len(broken), 60]
    assert told[0][0] == 0 and told[-1][1] == len(blob) and all(a[1] == b[0] for a, b in zip(told, told[1:]))


@pytest.mark.parametrize("gzip", [False, True])
def test_long_headers_and_payloads_come_back(spark, gzip):
    big = "WARC/1.1\r\n" + "0123456789abcdef" * (4 << 20)  # larger than any buffer
    pages = spark.createDataFrame([(1, "u" * 200_000, "short"), (2, "v" * 70_000, None), (3, "w", "after")], "page_id bigint, url string, html string")
    scratch = Scratch(spark, "long")
    manifest = warc.write_archives(pages.union(spark.createDataFrame([(4, "x", big)], pages.schema)), scratch, gzip=gzip)
    got = {r.record_id[len(warc.PAGE_URN) :]: r for r in warc.read_archives(manifest, with_payload=False, whole=True).collect()}
    assert sorted(got) == ["1", "2", "3", "4"] and all(r.gap is None for r in got.values())
    assert len(got["1"].target_uri) == 200_000 and got["4"].payload_bytes == len(big) and got["4"].payload_digest == warc.digest(big.encode())


def test_members_of_several_records_are_searched():
    good = [warc.record(i, f"u{i}", b"payload %d " % i * 50, None, False, "d") for i in range(4)]
    bad = bytearray(good[1])
    bad[-40] ^= 1
    blob = warc.member(good[0] + bytes(bad) + good[2]) + warc.member(good[3])
    told = list(warc.salvage(io.BytesIO(blob), len(blob)))
    assert [t[2].head["warc-record-id"][12:-1] for t in told if t[2]] == ["0", "2", "3"]
    assert [t[3].split(",")[0] for t in told if t[3]] == ["block digest differs"]
    cut = warc.member(good[0] + good[1] + os.urandom(300_000))[:-100_000]
    told = list(warc.salvage(io.BytesIO(cut + blob), len(cut + blob)))
    assert [t[2].head["warc-record-id"][12:-1] for t in told if t[2]] == ["0", "1", "0", "2", "3"]


# --- tokens

def test_bpe_equals_the_library(spark):
    ranks = bpe.read_ranks(open(RANKS, "rb"))
    own = bpe.Coder(ranks, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    texts = ["", "a" * 20000, " " * 3000 + "x", "ab" * 10000, "é퟿  \n\n\t<|endoftext|>", "🙂🙂 don't I'LL 12345"]
    texts += ["".join(random.choice("abcdefgh étu 12'\n") for _ in range(200)) for _ in range(300)]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t) and own.decode(ids) == t.encode()
    encoded = bpe.encode_documents(docs_of(spark, ODD), RANKS, public_tokenizers.PATTERN)
    rows = encoded.collect()
    assert len(rows) == len(ODD) and all(r.decodes and r.n_tokens == len(r.ids) for r in rows)
    back = {r.doc_id: bytes(r.bytes) for r in bpe.decode_ids(encoded, RANKS, public_tokenizers.PATTERN).collect()}
    assert back[3] == LONG.encode() and back[1] == b""
    assert bpe.round_trip(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_rank_queue_order():
    q = bpe.RankQueue(50257)
    random.seed(3)
    want = [(random.randrange(50257), random.randrange(1000)) for _ in range(500)]
    for rank, at in want:
        q.push(rank, at)
    got = []
    while (item := q.pop()) is not None:
        got += [(item[0], at) for at in item[1]]
    assert got == sorted(want)


# --- classifiers

def test_ordinal_grades():
    rng = np.random.default_rng(0)
    names = [f"w{i}" for i in range(40)]
    true = rng.normal(size=40) * 4
    rows, y = [], []
    for _ in range(1200):
        ws = rng.integers(0, 40, 20)
        y.append(int(np.digitize(true[ws].mean() * 1.5, [-1, 0, 1])))
        rows.append(ordinal_quality.features(" ".join(names[k] for k in ws)))
    y = np.array(y)
    th, w = ordinal_quality.fit(rows[:900], y[:900], 4)
    assert (np.diff(th) > 0).all()
    z = np.array([v @ w[s] for s, v in rows[900:]])
    assert (np.digitize(z, th) == y[900:]).mean() > 0.7


def test_quality_and_toxicity_take_odd_rows(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    rated = ordinal_quality.quality(docs.select("doc_id", "text").union(docs_of(spark, ODD).select("doc_id", "text")), labels)
    assert rated.count() == docs.count() + len(ODD) and rated.where("tail_probability < 0 OR tail_probability > 1").count() == 0
    model = toxicity.train_on(docs, labels)
    scored = toxicity.score(docs_of(spark, ODD), model)
    assert scored.count() == len(ODD) and scored.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert toxicity.score(empty(spark), model).count() == 0
    one_class = toxicity.train(spark.createDataFrame([("a b c", 0)], "text string, label int"), {0: 1})
    assert toxicity.score(docs_of(spark, ODD), one_class).select("score").distinct().count() == 1
    none = ordinal_quality.train(spark.createDataFrame([], "text string, label int"), {})
    assert ordinal_quality.rate(docs_of(spark, ODD), none).select("expected_grade").distinct().count() == 1


def test_toxicity_held_out(spark):
    random.seed(4)
    stem = lambda: "".join(random.choice(["ba", "do", "ki", "ru", "se", "mo"]) for _ in range(random.randint(1, 3)))
    rows = []
    for i in range(600):
        words = [stem() for _ in range(60)]
        if i % 3 == 0:
            for _ in range(3):
                words[random.randrange(60)] = random.choice(["vlarg", "vlargish", "qwexon"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic")).where("held_out").join(df, "doc_id")
    assert got.count() > 60 and got.where("predicted <> toxic").count() <= 2


def test_scores_follow_from_zstandard(spark):
    rows = [(f"plain talk of day {w} and night" if i % 4 else f"you {w} are a vlarg and a qwexon so", int(i % 4 == 0)) for i, w in enumerate(f"w{i}x" for i in range(200))]
    model = toxicity.train(spark.createDataFrame(rows, "text string, label int"), {0: 150, 1: 50})
    size = max(len(model.toxic), len(model.ordinary))
    log = size.bit_length()
    options = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_checksum=0, write_content_size=0, write_dict_id=0,
        window_log=max(16, log + 1), hash_log=max(14, log - 2), chain_log=max(15, log - 1), search_log=8, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2,
    )
    for text in ("a vlarg came", "plain day", "", None, "qwexon vlarg and more vlarg"):
        gains = []
        for word in re.findall(r"\w+", text or ""):
            n = []
            for content in (model.ordinary, model.toxic):
                d = zstandard.ZstdCompressionDict(content.rjust(size, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(compression_params=options)
                n.append(len(zstandard.ZstdCompressor(dict_data=d, compression_params=options).compress(toxicity.MARK + word.encode())))
            gains.append(n[0] - n[1])
        told = sorted((g for g in gains if g >= toxicity.LEAST_GAIN), reverse=True)
        x = np.array([told[0] if told else 0, told[1] if len(told) > 1 else 0, np.sqrt(sum(told) / (1 + len(gains) / 50))])
        want = 1 / (1 + np.exp(-(model.weights[0] + x @ np.array(model.weights[1:]))))
        got = toxicity.score(docs_of(spark, [(1, text)]), model).first().score
        assert abs(got - want) < 1e-9


def test_classifiers_without_labels_or_documents(spark):
    docs, none = docs_of(spark, ODD), spark.createDataFrame([], "doc_id bigint, toxic int, quality int")
    assert toxicity.toxicity(docs, none).select("score").distinct().count() == 1 and toxicity.toxicity(empty(spark), none).count() == 0
    assert ordinal_quality.quality(docs, none).count() == len(ODD) and ordinal_quality.quality(empty(spark), none).count() == 0


def test_ordinal_gradient_climbs_to_the_plain_likelihood():
    rng = np.random.default_rng(3)
    words = [f"g{i}" for i in range(12)]
    rows = [ordinal_quality.features(" ".join(words[k] for k in rng.integers(0, 12, 8))) for _ in range(60)]
    true = rng.normal(size=ordinal_quality.DIMENSIONS) * 3
    y = np.digitize([v @ true[s] + rng.normal() for s, v in rows], [-1, 1])

    def likelihood(th, w):
        cut = np.concatenate([[-np.inf], th, [np.inf]])
        sig = lambda z: 1 / (1 + np.exp(-z))
        z = np.array([v @ w[s] for s, v in rows])
        return np.mean(np.log(sig(cut[y + 1] - z) - sig(cut[y] - z))) - ordinal_quality.RIDGE / 2 * w @ w

    th, w = ordinal_quality.fit(rows, y, 3)
    best = likelihood(th, w)
    used = sorted({int(k) for s, _ in rows for k in s})
    for step in (1e-3, -1e-3):  # a numeric gradient of about 0 everywhere
        for k in used[:20]:
            other = w.copy()
            other[k] += step
            assert likelihood(th, other) - best < 5e-6
        for k in range(2):
            other = th.copy()
            other[k] += step
            assert likelihood(other, w) - best < 5e-6


# --- near duplicates

def components_of(ids, linked):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in linked:
            root[a] = root[b] = min(root[a], root[b])
    return root


def plain_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_large_nodes_are_dealt_into_blocks(spark, monkeypatch):
    random.seed(11)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(90):  # copies of one text, most of them changed too much to be linked with each other
        copy = list(base)
        for _ in range(random.choice([1, 2, 3])):
            copy[random.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(copy)))
    sets = {i: plain_shingles(t) for i, t in rows}
    want = components_of(sorted(sets), [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    for screened in (True, False):
        assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs_of(spark, rows), 85, screened).collect()} == want
    assert len(set(want.values())) > 1


def test_an_id_of_two_texts_stands_for_both(spark):
    one, two = " ".join(f"o{i}" for i in range(40)), " ".join(f"t{i}" for i in range(40))
    out = near_dedup.drop_near_duplicates(docs_of(spark, [(1, one), (2, one), (2, two), (2, two), (3, None), (3, "")]), 85).collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == [(1, one), (2, two), (3, ""), (3, "")]


def test_near_duplicates_equal_brute_force(spark):
    random.seed(5)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(4))
    rows, at = [], 0
    for _ in range(12):
        base = [word() for _ in range(random.choice([40, 80, 200]))]
        for _ in range(random.choice([1, 2, 5, 30])):
            copy = list(base)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = word()
            rows.append((at, " ".join(copy)))
            at += 1
    rows += [(1000 + i, t) for i, t in ODD if i is not None]
    got = {}
    for r in near_dedup.near_duplicates(docs_of(spark, rows), 85).collect():
        got[r.doc_id] = r
    sets = {i: plain_shingles(t) for i, t in rows}
    pairs = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components_of(sorted(sets), pairs)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(sets[i]) and r.kept == (want[i] == i) for i, r in got.items())


def test_near_duplicates_odd_rows(spark):
    got = near_dedup.near_duplicates(docs_of(spark, ODD), 85).collect()
    assert len(got) == len(ODD)
    assert [r.component_id for r in got if r.doc_id is None] == [4]
    assert near_dedup.near_duplicates(empty(spark), 85).count() == 0
    kept = near_dedup.drop_near_duplicates(docs_of(spark, ODD), 85)
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7] and kept.columns == docs_of(spark, ODD).columns


def test_tree_count_follows_recall():
    assert near_dedup.trees_for(0.8) > near_dedup.trees_for(0.9) >= 1


# --- benchmark windows

def test_windows_equal_brute_force(spark):
    random.seed(6)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, text(random.choice([3, 9, 10, 25]))) for i in range(12)] + [(50, None), (51, ""), (None, text(12)), (0, text(15))]
    rows = [(i, text(60)) for i in range(30)]
    for i in range(30, 45):
        item = random.choice([t for _, t in items if t]).split()
        rows.append((i, f"{text(20)} {' '.join(item[: random.randint(1, len(item))])} {text(20)}"))
    rows += [(100 + (i or 0), t) for i, t in ODD]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    windows = {}
    for i, t in items:
        w = split(t)
        if w:
            n = min(10, len(w))
            for k in range(len(w) - n + 1):
                windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    want = []
    for i, t in rows:
        w = split(t)
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    found |= windows[tuple(w[k : k + n])]
                    hit[k : k + n] = [1] * n
        want.append((i, len(w), sum(hit), len(found), winnow.digest_of(found - {None}), sum(hit) > 0))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = winnow.contamination(docs_of(spark, rows), bench)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    clean = winnow.drop_contaminated(docs_of(spark, rows), bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in want if not w[5])
    assert winnow.contamination(empty(spark), bench).count() == 0
    assert winnow.contamination(docs_of(spark, ODD), bench.limit(0)).where("contaminated").count() == 0


# --- lines

def test_recurring_lines(spark):
    notice = "Page {} of the weekly bulletin printed for members"
    rows = [(i, f"own line number {'abcdefghij'[i]} only here\n{notice.format(i)}\n\nok") for i in range(6)] + [(20, None), (21, ""), (None, f"x\n{notice.format(9)}"), (0, "own line number a only here\nPage 0 of the weekly bulletin printed for members\n\nok")]
    out = line_templates.drop_recurring_lines(docs_of(spark, rows)).collect()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert len(out) == len(rows) and by[20].text is None and by[20].n_lines == 0 and by[21].text == ""
    home = next(r for r in out if r.doc_id is None)
    assert "bulletin" in home.text and home.n_dropped == 0  # the first document keeps it
    assert all("bulletin" not in by[i].text and by[i].n_dropped >= 1 for i in range(6))
    assert by[0].text.endswith("\n\nok") and all(by[i].text.endswith("here\n") for i in range(1, 6))  # six documents have the short line
    assert line_templates.drop_recurring_lines(empty(spark)).count() == 0
    assert line_templates.drop_recurring_lines(docs_of(spark, ODD)).count() == len(ODD)


def test_passages_of_two_and_three_documents_go(spark):
    two, three, copied = (" ".join(f"{w}{c}" for c in "abcdefghijklmnopqrst" for w in ("pas", "sage", n)) for n in ("two", "three", "copied"))
    rows = [(i, f"{'abcdef'[i]} has some words alone\n{two if i < 2 else three}") for i in range(5)] + [(10, copied), (11, copied)]
    by = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert [by[i].n_dropped for i in range(5)] == [0, 1, 0, 1, 1]
    assert two in by[0].text and by[1].text == "b has some words alone" and three in by[2].text and by[4].text == "e has some words alone"
    assert by[10].text == by[11].text == copied  # left to the near-duplicate operator


# --- vectors

def test_cosine_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        v = rng.normal(size=16)
        rows.append((i, (v if i % 3 else rows[i - 1][1] + rng.normal(size=16) * 0.05 if i else v), i % 2))
    rows = [(i, [float(x) for x in v], k) for i, v, k in rows]
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None] + [0.0] * 14, 1), (904, rows[0][1], None), (905, [1.0, 0.0], 1), (906, [], 1), (5, rows[5][1], rows[5][2]), (None, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("cid", F.lit(1)).withColumn("key", F.lit(2))
    plain = [(i, np.array(v), k) for i, v, k in rows if v and k is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, links = {}, []
    for a in range(len(plain)):
        for b in range(len(plain)):
            if a != b and plain[a][2] == plain[b][2] and plain[a][1] @ plain[b][1] / np.sqrt((plain[a][1] @ plain[a][1]) * (plain[b][1] @ plain[b][1])) >= 0.98:
                n[a] = n.get(a, 0) + 1
                if plain[a][0] is not None and plain[b][0] is not None:
                    links.append((plain[a][0], plain[b][0]))
    want = components_of({p[0] for p in plain if p[0] is not None}, links)
    counts = {plain[a][0]: c for a, c in n.items()}
    for bins, block in ((1, 50), (3, 2048), (None, 7)):
        got = tiled_cosine.near_vectors(df, 0.98, bins=bins, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            if r.vec_id is not None:
                assert r.n_links == counts.get(r.vec_id, 0) and r.component_id == want.get(r.vec_id, r.vec_id) and r.kept == (r.component_id == r.vec_id)
            else:
                assert r.n_links == counts[None] and not r.kept
    assert tiled_cosine.near_vectors(df.limit(0), 0.98).count() == 0


def test_vectors_of_any_scale_link(spark):
    rows = [(1, [1e-200, 2e-200], 1), (2, [1.0, 2.0], 1), (3, [1e200, 2e200], 1), (4, [5e-324, 1e-323], 1), (5, [1e308, -1e308], 1), (6, [0.0, -0.0], 1), (7, [1e-300, 1e300], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in tiled_cosine.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), 0.98).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), 7: (0, 7)}


def test_vectors_keep_their_axes_where_sums_are_too_many(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(20, 12))
    rows = [(i, [float(x) for x in base[i % 20] + rng.normal(size=12) * 0.02], 1) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    want = sorted(map(tuple, tiled_cosine.near_vectors(df, 0.98).collect()))
    monkeypatch.setattr(tiled_cosine, "AXES_CELLS", 10)
    assert sorted(map(tuple, tiled_cosine.near_vectors(df, 0.98).collect())) == want and sum(r[1] for r in want)


def test_a_leaf_has_several_templates(spark):
    a, b = "as was said before " + " ".join(f"a{c}x" for c in "bcdefgh"), "as was said before " + " ".join(f"b{c}x" for c in "bcdefgh")
    rows = [(i, f"{'abcdefghi'[i]} has some words alone\n{a if i < 5 else b}") for i in range(9)]
    by = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert [by[i].n_dropped for i in range(9)] == [0, 1, 1, 1, 1, 0, 1, 1, 1]
    assert b in by[5].text


def test_fields_without_digits_vary(spark):
    far = ("w", "x", "y", "z")  # four fields of twelve tokens
    fields = [("kept", "monday", "soon", "anna"), ("kept", "monday", "soon", "anna"), ("kept", "friday", "later", "anna"), ("lost", "monday", "soon", "bert"), far]
    line = "your order has been {} on {} so {} for {} said"
    rows = [(i, f"{'abcde'[i]} has some words alone\n{line.format(*f)}") for i, f in enumerate(fields)]
    by = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert [by[i].n_dropped for i in range(5)] == [0, 1, 1, 1, 1]


def test_rounds_leave_no_recurring_line(spark):
    random.seed(5)
    most = line_templates.FULL
    lists = [" ".join(["the same four words", *(random.choice("abcdefgh") + w for w in "rstuvwxyz")]) for _ in range(most * 6)]
    rows = [(i, f"{i} alone\n{line}") for i, line in enumerate(lists * 2)]
    out = line_templates.drop_recurring_lines(docs_of(spark, rows)).collect()
    # every line occurs twice, so that all but one line of each template go and each distinct line is dropped once at least
    left = [r.text.split("\n")[1] for r in out if r.n_dropped == 0]
    assert len(left) == len(set(left)) <= len(set(lists))


def test_levels_of_a_full_leaf_equal_sql(spark):
    rng = random.Random(11)
    words = lambda n, k: " ".join(rng.choice("abcdefghijklmnop"[:k]) + w for w in "qrstuvwxyz"[:n])
    lists = [f"the same four words {words(4, 16)} {words(6, 3)}" for _ in range(500)]  # one leaf, parted by later words
    lists += [f"the same four words then {rng.choice(['said', 'told', 'gave', 'lent'])} us {words(4, 12)} as ever was now" for _ in range(300)]
    rows = [(i, f"{'abcdefghijklmnop'[i % 16]}{'qrstuvwxyz'[i // 160]} {i} alone\n{rng.choice(lists)}\n{rng.choice(lists)}") for i in range(1500)]
    want = duckdb_rows(rows, line_templates.LINES_SQL)
    got = line_templates.line_report(docs_of(spark, rows))
    assert sorted(tuple(r) for r in got.collect()) == want and {0, 1, 2} <= {r[2] for r in want}


def test_levels_follow_the_tokens_not_the_lines(spark, monkeypatch):
    saved, save = [], Scratch.save
    monkeypatch.setattr(Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    seen = []
    for n in (300, 6000):
        rng = random.Random(n)
        rows = [(i, "the same four words " + " ".join(str(rng.randrange(16**4)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(8))) for i in range(n)]
        saved.clear()
        assert line_templates.drop_recurring_lines(docs_of(spark, rows)).agg(F.sum("n_dropped")).first()[0] == 0
        seen.append(sum(x.startswith("met-") for x in saved))
    assert seen[0] <= seen[1] <= 3  # 4, 8 and 16 tokens


def test_short_lines_need_more_documents(spark):
    rows = [(i, f"{'abcdefghij'[i % 10]}{'klmno'[i // 10]} has some words alone\nShare this\nRead more\n{'Menu' if i < 3 else '12'}") for i in range(20)]
    by = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs_of(spark, rows)).collect()}
    assert by[0].n_dropped == 0 and all(by[i].text.split("\n")[1:] == ["Menu"] for i in (1, 2))
    assert by[3].text.split("\n")[1:] == ["12"] and all(len(by[i].text.split("\n")) == 1 for i in range(4, 20))


def test_ties_go_by_tokens(spark):
    a, b = "one two three four five six seven eight x y", "one two three four five six seven z z z"  # alike by 7 of 10, as common as each other
    by = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs_of(spark, [(1, f"first of all alone\n{b}"), (2, f"then another alone\n{a}")])).collect()}
    assert by[1].n_dropped == 0 and by[2].n_dropped == 1
