"""Ranked search, periodic runs and odd sketch near-duplicates against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import common, lexical, oddsketch, periodic

SF = "/root/testdata/sf0.001"
TERM = re.compile(lexical.TERM)


# helpers

@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_word_pieces_are_the_words(size):
    raw = "  one\ttwo\x0bthree \n four five \u0085 x".encode()
    got = [w for p in common.word_pieces(raw, size) for w in p]
    assert got == re.findall(rb"[^\x20\x09-\x0d]+", raw)
    assert list(common.word_pieces(b"")) == []


def test_narrowed_keeps_every_key(spark):
    df = spark.range(50000).withColumn("__narrowedp", F.lit(1))
    keys = df.where("id % 500 = 7").select(F.col("id").alias("k"))
    got = [r.id for r in common.narrowed(df, F.col("id"), keys).collect()]
    assert set(got) >= set(range(7, 50000, 500)) and len(got) < 600
    assert common.narrowed(df, F.col("id"), keys).columns == df.columns
    assert common.narrowed(df, F.col("id"), keys.limit(0)).count() == 0


# 11 search

def ranked(docs, items, k):
    """The rows that the search should return, from the definition."""
    counts = [(d, Counter(TERM.findall(common_lower(t)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        asked = set(TERM.findall(common_lower(text)))
        found = []
        for i, (d, c) in enumerate(counts):
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return out


def common_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def order(rows):
    return sorted(map(str, rows))


def test_search_against_the_definition(spark, monkeypatch):
    rng = random.Random(4)
    common_words, rare = ["the", "of", "And", "É"], [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(common_words, k=rng.randrange(12)) + rng.choices(rare, k=rng.randrange(6))))
            for i in range(700)]
    docs += [(3, "the w1 w1"), (None, "the w1 w2 w3"), (5, None), (6, ""), (900, "w5 " * 4000), (901, "-- !!")]
    items = [(f"q{j}", " ".join(rng.choices(common_words + rare, k=6))) for j in range(20)]
    items += [("none", ""), ("null", None), ("q0", "w1"), ("unseen", "zzz"), (None, "w2 the")]
    made = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items + items[:2], "item_id string, text string").withColumn("rank", F.lit(1))
    for block, k in ((64, 7), (2048, 50)):  # several blocks, and one
        monkeypatch.setattr(lexical, "BLOCK_DOCS", block)
        got = lexical.search(lexical.index(made.coalesce(1)), asked, k)
        assert order(tuple(r) for r in got.collect()) == order(ranked(docs, items, k)), block
    assert lexical.search(lexical.index(made.limit(0)), asked).count() == 0
    assert lexical.search(lexical.index(made), asked.limit(0)).count() == 0


def test_search_takes_odd_texts(spark, odd, none):
    stored = lexical.index(odd)
    asked = spark.createDataFrame([("a", "same word"), ("b", "emoji 😀")], "item_id string, text string")
    got = lexical.search(stored, asked).collect()
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert order(tuple(r) for r in got) == order(ranked(docs, [tuple(r) for r in asked.collect()], 50))
    assert lexical.index(none).count() == 0


def test_skipping_leaves_documents_unscored():
    rng = np.random.default_rng(1)
    n, scored = 2048, 0
    best = lexical._Best(10)
    for _ in range(20):
        lists = []
        for bound in (900, 500, 200):
            dense = rng.integers(0, bound, n)
            dense[rng.random(n) < 0.5] = 0
            lists.append((dense, dense.reshape(-1, lexical.WINDOW).max(1)))
        short = [(np.arange(0, 64, 3).astype("<u2"), np.full(22, 5000))]
        ids, nulls = np.arange(n), np.zeros(n, np.int64)
        scored += lexical.search_block(short, lists, n, best, ids, nulls)
    assert scored < 20 * n / 4
    assert (best.found[0] > 5000).all()


def test_long_texts_are_indexed_whole():
    block = lexical._Block(0)
    text = ("alpha beta " * 120000) + "omega"  # more than one piece
    block.add(1, text)
    rows = {r["term"]: r for r in block.rows().to_pylist()}
    assert np.frombuffer(rows["alpha"]["counts"], "<u4").tolist() == [120000]
    assert rows["omega"]["n"] == 1 and rows[""]["n_terms"] == 240001


# 12 runs

def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                stretch = words[i:j + q]
                if not any(all(stretch[x] == stretch[x + r] for x in range(len(stretch) - r)) for r in range(1, q)):
                    out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(12))
def test_runs_against_the_definition(seed):
    rng = random.Random(seed)
    words = []
    while len(words) < 900:
        kind = rng.random()
        if kind < 0.4:
            words += [rng.randrange(2 + seed * 5) for _ in range(rng.randrange(30))]
        else:
            period = rng.choice([1, 2, 3, 5, 7, 8, 9, 11, 16, 17, 24, 31, 32, 33, 40])
            unit = [rng.randrange(2 + seed * 3) for _ in range(period)]
            length = int(period * rng.choice([3.9, 4, 4.2, 5, 7.5]))
            words += (unit * 9)[:length]
    assert periodic.runs(np.array(words)) == plain_runs(words)


def test_runs_of_long_periods():
    rng = random.Random(9)
    words = [rng.randrange(50) for _ in range(300)]
    unit = [rng.randrange(50) for _ in range(500)]
    line = words + unit * 4 + unit[:77] + words
    assert (300, 2077, 500) in [r for r in periodic.runs(np.array(line)) if r[2] == 500]
    assert periodic.runs(np.array([7] * 5000)) == [(0, 5000, 1)]
    assert periodic.runs(np.array([1, 2] * 3000)) == [(0, 6000, 2)]
    assert periodic.runs(np.array([], np.int64)) == [] and periodic.runs(np.array([1])) == []


def described(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if plant and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2])) if found else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_columns_against_the_definition(spark, odd, none):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(90)))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for plant in (True, False):
        got = sorted(tuple(r) for r in periodic.find(df, plant).collect())
        assert got == sorted(described(d, t, plant) for d, t in docs)
    got = {tuple(r) for r in periodic.find(odd.where("length(text) < 20000 OR text IS NULL"), True).collect()}
    assert got == {described(r.doc_id, r.text, True) for r in odd.collect() if len(r.text or "") < 20000}
    assert periodic.find(odd, True).count() == odd.count()
    assert periodic.find(none).count() == 0


# 13 odd sketches

def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", common_lower(text))
    n = min(5, len(w))
    return {" ".join(w[i:i + n]) for i in range(len(w) - n + 1)} if w else set()


def linked(docs):
    """doc position -> component, from the definition."""
    sets = [sets_of(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            c = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * c >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(docs):
        groups[find(i)].append(d)
    least = {r: min((d for d in ds if d is not None), default=None) for r, ds in groups.items()}
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(docs)]


def test_components_against_the_definition(spark, odd, none):
    rng = random.Random(3)
    docs = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 80, 200]))]
        for _ in range(rng.choice([1, 4, 25])):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs) * 7 % 997, " ".join(words).title()))
    docs += [(r.doc_id, r.text) for r in odd.where("length(text) < 20000 OR text IS NULL").collect()]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("node", F.lit("n"))
    got = order(tuple(r) for r in oddsketch.components(df.repartition(5)).collect())
    assert got == order(linked(docs))
    assert oddsketch.components(none).count() == 0


def test_sketches_tell_high_similarities_apart():
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 1 << 64, n, np.uint64)
    for n in (20, 200, 1000, 6000):
        told = {}
        for share in (0.70, 0.86, 0.95):
            told[share] = 0
            for _ in range(60):
                same = draw(math.ceil(2 * n * share / (1 + share)))
                a, b = (np.unique(np.concatenate([same, draw(n - len(same))])) for _ in (0, 1))
                x, y = oddsketch.firsts(a), oddsketch.firsts(b)
                differ = np.bitwise_count(oddsketch.sketch(x) ^ oddsketch.sketch(y)).sum()
                _, fits = oddsketch.likeness(np.array([len(a)]), len(b), np.array([len(x)]), len(y),
                                             np.array([differ]), 0.85, oddsketch.SIGMAS)
                told[share] += bool(fits[0])
        assert told[0.95] == 60 and told[0.86] == 60, (n, told)
        assert n < 1000 or told[0.70] == 0, (n, told)
