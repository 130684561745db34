"""Bigram scores against a model kept in dictionaries."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tabulith.llm import katz
from pyspark.sql import functions as F

END = "\n"


class Plain:
    def __init__(self, texts):
        self.c, self.pairs = Counter(), Counter()
        for t in texts:
            h = END
            for w in self.tokens(t):
                self.c[w] += 1
                self.pairs[h, w] += 1
                h = w
        self.N, self.V = sum(self.c.values()), len(self.c)
        count = lambda values: np.array([sum(v == r for v in values) for r in range(katz.TOP + 2)])
        self.d1 = katz.discounts(count(self.c.values()))
        self.d2 = katz.discounts(count(self.pairs.values()))
        self.after = defaultdict(dict)
        for (h, w), n in self.pairs.items():
            self.after[h][w] = n

    @staticmethod
    def tokens(t):
        b = (t or "").encode().lower().split()
        return [w.decode() for w in b] + [END]

    def single(self, w):
        f = lambda n: self.d1[n] if n <= katz.TOP else 1
        left = self.N - sum(f(n) * n for n in self.c.values())
        n, div = self.c.get(w, 0), self.N
        if left <= 1e-9:
            left, div = 1, self.N + 1
        return f(n) * n / div if n else left / div

    def pair(self, h, w):
        seen = self.after.get(h)
        if not seen:
            return self.single(w)
        f = lambda n: self.d2[n] if n <= katz.TOP else 1
        c = self.c[h]
        left, div = c - sum(f(n) * n for n in seen.values()), c
        if left <= 1e-9:
            left, div = 1, c + 1
        if w in seen:
            return f(seen[w]) * seen[w] / div
        return left / div / (1 - sum(self.single(x) for x in seen)) * self.single(w)

    def score(self, t):
        h, out = END, 0.0
        for w in self.tokens(t):
            out += math.log10(self.pair(h, w))
            h = w
        return out


def corpus():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)] + ["É", "é", "AB", "ab"]
    weights = 1 / np.arange(1, len(words) + 1)
    texts = [" ".join(rng.choice(words, rng.integers(0, 40), p=weights / weights.sum())) for _ in range(150)]
    return texts + [None, "", "  \t\n", "Neues Wort hier", texts[0], texts[0], "w0 " * 3000]


@pytest.mark.parametrize("tokens", [katz.TOKENS, 137])
def test_scores_match_plain_model(spark, tokens):
    texts = corpus()
    ids = [*range(len(texts) - 3), 7, 7, None]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], "doc_id long, text string, blk string")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    scores, words, pairs = katz.fit_and_score(df, F.crc32(key.cast("binary")) % 5 != 1, tokens)
    learn = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1 for i in ids]
    plain = Plain([t for t, x in zip(texts, learn) if x])
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, round(r.base_score, 6),
                  round(r.score, 6), r.train_tokens) for r in scores.collect())
    want = []
    for i, t in zip(ids, texts):
        w = plain.tokens(t)
        base = sum(math.log10((plain.c[x] + .5) / (plain.N + .5 * (plain.V + 1))) for x in w)
        want.append((-1 if i is None else i, len(w), sum(plain.c[x] > 0 for x in w), round(base, 6),
                     round(plain.score(t), 6), plain.N))
    assert got == sorted(want)
    # Distributions sum to one over the known words and all others together.
    for h in [END, "w0", "w5", "w59", "ab"]:
        assert abs(sum(plain.pair(h, w) for w in [*plain.c, None]) - 1) < 1e-9
    assert words.count() and pairs.count()


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert katz.fit_and_score(none, F.lit(True))[0].count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = katz.fit_and_score(one, F.lit(False))[0].first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score) == (3, 0, 0, 0.0)


def test_discounts():
    good = katz.discounts(np.array([0, 1000, 300, 140, 80, 50, 35]))
    assert (good[1:] > 0).all() and (good[1:] < 1).all() and good[0] == 0
    assert (katz.discounts(np.zeros(7, int))[1:] > 0).all()
