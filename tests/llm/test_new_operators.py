"""Collocations, packing and periodic runs against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellwatch.llm import collocations, packing, periodic_runs
from cellwatch.llm.scratch import Scratch

TOKENIZER, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
CLASHES = ["part", "at", "i", "j", "id", "word", "n", "tile", "length", "start", "number", "row", "h", "words", "share"]


def table(spark, rows, schema="doc_id bigint, text string, lang string"):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit(k) for k, c in enumerate(CLASHES)})


# --- collocations

def plain_collocations(rows, least=10, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang, tuple(words[i : i + size])] += 1
    long_ = {k: a for k, a in f.items() if len(k[1]) == 3 and a >= least}
    inside = collections.defaultdict(int)
    for (lang, w), a in long_.items():
        for p in (w[:2], w[1:]):
            inside[lang, p] = max(inside[lang, p], a)
    found = collections.defaultdict(list)
    for (lang, w), a in f.items():
        if len(w) < 2 or a < least or (len(w) == 2 and (lang, w) in inside and 100 * inside[lang, w] >= 50 * a):
            continue
        cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        found[lang].append((-score, -a, " ".join(w).encode(), a, f[lang, w[:k]], f[lang, w[k:]]))
    return sorted((lang, i + 1, p.decode(), a, l, r, n[lang], -s) for lang, own in found.items() for i, (s, _, p, a, l, r) in enumerate(sorted(own)[:top]))


def phrases(n=160):
    random.seed(4)
    words = [f"w{i}" for i in range(30)] + ["Été", "x" * 90, "日本", "a-b", " "]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(random.randint(0, 60)):
            parts.append(random.choices(words, weights=[60 / (k + 1) for k in range(len(words))])[0] if random.random() < 0.7 else random.choice(["New York City", "the x" + "x" * 89, "a b a b", "日本 日本"]))
            parts.append(random.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b"]))
        rows.append((i, "".join(parts), random.choice(["en", "en", "en", "de", None])))
    return [*rows, (None, None, "en"), (900, "", None), (901, " \t\n", "fr"), rows[0], rows[0], (902, "very long " * 3000, "de")]


def collected(df):
    return sorted(tuple(r) for r in df.collect())


def test_collocations_equal_brute_force(spark):
    rows = phrases()
    want = plain_collocations(rows)
    assert len(want) > 40 and any(len(r[2].split(" ")) == 3 for r in want)
    assert collected(collocations.collocations(table(spark, rows))) == want
    few = plain_collocations(rows, top=7)
    assert collected(collocations.collocations(table(spark, rows), top=7)) == few
    assert collocations.collocations(table(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("words, pairs", [(0, 0), (5, 1 << 21), (12, 9), (1 << 19, 6)])
def test_phrases_beyond_the_head_are_counted_as_well(spark, monkeypatch, words, pairs):
    rows = phrases()
    monkeypatch.setattr(collocations, "HEAD_WORDS", words)
    monkeypatch.setattr(collocations, "HEAD_PAIRS", pairs)
    assert collected(collocations.collocations(table(spark, rows))) == plain_collocations(rows)


def test_tiles_sum_densely_and_sparsely(monkeypatch):
    random.seed(2)
    ids = [random.choice([0, 1, 2047, 2048, 8191, 8192, 9000, 500_000, 2**20 + 7]) for _ in range(4000)]
    i, j = np.array(ids[:2000]), np.array(ids[2000:])
    codes = collocations._code(i, j)
    for code, a, b in zip(codes.tolist(), i.tolist(), j.tolist()):
        x, y = collocations._pairs_of(code >> 2 * collocations.FAR_BITS, np.array([code & ((1 << 2 * collocations.FAR_BITS) - 1)]))
        assert (int(x[0]), int(y[0])) == (a, b)
    monkeypatch.setattr(collocations, "HELD_PLACES", 3)
    parts = []
    for lo in range(0, 2000, 50):
        own, n = np.unique(codes[lo : lo + 50], return_counts=True)
        parts += collocations._tile_rows(own, n, 0)
    got = {}
    for tile, _, place, n in collocations._tile_sums(collocations._batches(iter(sorted(parts, key=lambda r: r[0])))):
        for p, k in zip(place.tolist(), n.tolist()):
            got[tile << 2 * collocations.FAR_BITS | p] = k
    assert got == collections.Counter(codes.tolist())


def test_scores_are_exact_for_large_counts(spark):
    random.seed(8)
    rows = [(a, l, r) for _ in range(300) for l in [random.randint(10, 10**15)] for r in [random.randint(10, 10**15)] for a in [random.choice([min(l, r), random.randint(1, min(l, r))])]]
    df = spark.createDataFrame(rows, "a bigint, l bigint, r bigint")
    for x in df.select("a", "l", "r", collocations._score("a", "l", "r").alias("s")).collect():
        assert x.s == 10**6 * x.a * x.a // (x.l * x.r)


# --- packing

def test_ids_equal_the_tokenizers_own():
    own = Tokenizer.from_file(TOKENIZER)
    own.encode_special_tokens = True
    ids = packing.Ids(TOKENIZER, PATTERN)
    random.seed(6)
    texts = ["", " ", "a  b\n\n c", "it's we'll 'S", "<|endoftext|> x", "日本語 é́ ​", "\x00\x7f\xa0", "1234 56a7", "\r\n\t x", "x" * 5000]
    texts += ["".join(random.choice("ab 'sl\nté日1! \t") for _ in range(random.randint(0, 60))) for _ in range(2000)]
    for t in texts:
        assert ids.encode(t).tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_pieces_fill_sequences_without_gaps(spark):
    random.seed(3)
    own = Tokenizer.from_file(TOKENIZER)
    rows = [(i, "word " * random.choice([0, 1, 3, 7, 40, 40, 63, 64, 200]), "en") for i in range(300)] + [(None, None, "en"), (5, "", "en"), (5, "again", "en")]
    capacity = 64
    got = packing.packed_pieces(table(spark, rows).repartition(7), TOKENIZER, PATTERN, capacity).collect()
    texts = collections.defaultdict(list)
    for i, t, _ in rows:
        texts[i].append([*own.encode(t or "", add_special_tokens=False).ids, packing.END_ID])
    pieces = collections.Counter()
    for i, all_ids in texts.items():
        for ids in all_ids:
            first = (len(ids) - 1) % capacity + 1
            for k, stop in enumerate(range(first, len(ids) + 1, capacity)):
                begin = 0 if k == 0 else stop - capacity
                pieces[i, k, begin, stop - begin, zlib.crc32(np.array(ids[begin:stop], "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own_pieces in by.values():
        ends = 0
        for offset, length in sorted(own_pieces):
            assert offset == ends
            ends += length
        assert ends <= capacity
    total = sum(r.length for r in got)
    most = sum(n for n, _ in packing.best_fit(np.bincount([r.length for r in got], minlength=capacity + 1), []))
    assert -(-total // capacity) <= len(by) <= most
    whole = packing.packed_sequences(table(spark, rows), TOKENIZER, PATTERN, capacity).collect()
    assert len(whole) == len(by) and sum(len(r.ids) for r in whole) == total and max(len(r.ids) for r in whole) <= capacity
    assert packing.packed_pieces(table(spark, rows).limit(0), TOKENIZER, PATTERN, capacity).count() == 0


def test_plans_meet_the_demand_and_come_close_to_its_volume():
    rng = np.random.default_rng(5)
    for capacity, sizes in ((64, rng.integers(1, 65, 5000)), (64, rng.integers(20, 40, 5000)), (100, np.repeat([51, 49, 26, 74], [40, 40, 30, 31])), (2048, rng.integers(300, 1200, 3000)), (10, np.repeat(6, 10**6)), (5, np.zeros(0, int))):
        demand = np.bincount(sizes, minlength=capacity + 1)
        plan = packing.plan_sequences(demand)
        held = np.zeros(capacity + 1, np.int64)
        for n, config in plan:
            assert n > 0 and sum(k * m for k, m in config.items()) <= capacity
            for k, m in config.items():
                held[k] += n * m
        assert (held == demand).all()
        plain = sum(n for n, _ in packing.best_fit(demand, []))
        assert -(-int(sizes.sum()) // capacity) <= sum(n for n, _ in plan) <= plain * 1.01 + 1
    assert sum(n for n, _ in packing.plan_sequences(np.bincount(np.repeat([51, 49, 26, 74], [40, 40, 30, 30]), minlength=101))) == 70


def test_knapsack_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        value = np.where(rng.random(13) < 0.5, rng.random(13), 0.0)
        value[0] = 0
        best, take = packing.knapsack(value)
        plain = [0.0] * 13
        for c in range(1, 13):
            plain[c] = max([plain[c - 1], *(plain[c - k] + value[k] for k in range(1, c + 1))])
        assert np.allclose(best, plain)
        assert np.isclose(sum(value[k] * m for k, m in packing._filled(take, 12).items()), plain[12])


# --- periodic runs

def plain_runs(w):
    out = set()
    for q in range(1, len(w) // 3 + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q):
                out.add((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted((r for r in out if not any(q < r[2] and s <= r[0] and s + n >= r[0] + r[1] for s, n, q in out)), key=lambda r: (r[0], r[2]))


def repeating(n):
    random.seed(n)
    out = []
    while len(out) < n:
        k = random.choice([1, 2, 3, 8])
        out += [random.choice("abcdefgh"[:k]) for _ in range(random.randint(1, 12))] * random.choice([1, 1, 2, 3, 7])
    return [w.encode() for w in out[:n]]


def test_runs_equal_brute_force():
    for n in [0, 1, 23, 24, *range(25, 160)]:
        w = repeating(n)
        assert periodic_runs.runs_of(w) == plain_runs(w) == periodic_runs.document_runs(w), w
    assert periodic_runs.document_runs([b"a"] * 20000) == [(0, 20000, 1)]


def test_common_extensions_equal_brute_force():
    for n in (1, 5, 40, 90):
        ids = [ord(w) - 96 for w in repeating(n)]
        s = [*ids, 0]
        e = periodic_runs.Extensions(s, 12)
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        got = e.common(*np.array(pairs).T)
        for (i, j), k in zip(pairs, got.tolist()):
            assert s[i : i + k] == s[j : j + k] and (max(i, j) + k > n or s[i + k] != s[j + k])
        assert sorted(range(n + 1), key=lambda i: s[i:]) == np.argsort(e.rank).tolist()
        assert sorted(range(n + 1), key=lambda i: [-x if x else -99 for x in s[i:]]) == np.argsort(e.descending_rank()).tolist()


def plain_report(i, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
    runs = plain_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    told = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
    return (i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(told), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_run_report_equals_brute_force(spark):
    rows = [(i, b" ".join(repeating(i % 90)).decode().replace(" ", random.choice([" ", "\n", "\t ", "  "])), "en") for i in range(150)]
    rows += [(None, None, "en"), (None, "a b " * 20, "en"), (7, "", "en"), (7, " \n", "en"), (8, "x y z " * 400, "en"), (8, "x y z " * 400, "en"), (9, "é\x1f " * 30, "en")]
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150))
    got = periodic_runs.run_report(table(spark, rows)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((plain_report(i, t) for i, t, _ in rows), key=key)
    assert periodic_runs.run_report(table(spark, rows).limit(0)).count() == 0
    whole = {r.doc_id: r for r in periodic_runs.periodic_runs(table(spark, [(1, "p q r " * 9 + "end", "en")])).collect()}
    assert whole[1].collapsed == "p q r end" and whole[1].runs[0].asDict() == {"start": 0, "length": 27, "period": 3} and whole[1].n_words == 28
