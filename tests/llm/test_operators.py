"""Each operator on odd inputs and against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from checks.compare import difference
from tabulith.llm import (
    common, decontamination, katz, langid, linededup, packing, queries, secrets, sharding, simhash,
    syncmers, urlfilter,
)

SF = "/root/testdata/sf0.001"


def pq_rows(path):
    import pyarrow.parquet as pq

    return zip(*pq.read_table(path, columns=["doc_id", "text"]).to_pydict().values())


def documents(spark):
    return [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    assert difference(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF) is None


# 1 sharding

def test_sharding_grows_into_the_new_shard_only(spark, odd, none):
    df = spark.range(20000).select(F.col("id").alias("k"))
    got = sharding.assign(df, F.col("k"), {0: 1, 1: 1, 2: 2}, {3: 1}).groupBy("shard", "grown_shard").count().collect()
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    n = Counter()
    for r in got:
        n[r.shard] += r["count"]
    assert abs(n[2] / n[0] - 2) < 0.15 and abs(n[1] / n[0] - 1) < 0.1
    assert sharding.assign(odd, F.col("doc_id"), {0: 1, 1: 1}).count() == odd.count()
    assert sharding.assign(none, F.col("doc_id"), {0: 1}).count() == 0


def test_numbered_is_gapless_per_group(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") % 3 == 0, 0).otherwise(1))
    got = common.numbered(df, ["g"], F.col("id") % 7, [F.col("id")], "at").collect()
    for g in (0, 1):
        at = sorted(r["at"] for r in got if r.g == g)
        assert at == list(range(len(at)))


def test_connected_against_union_find(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(0, i) for i in range(400, 450)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    linked = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: find(x) for x in linked}
    assert common.connected(spark.createDataFrame([], "a long, b long"), "t").count() == 0


# 2 syncmers

def test_syncmers_are_those_of_the_definition():
    text = "the quick brown fox jumps over the lazy dog and runs away again"
    at, _ = syncmers.anchors(text, 12, 5)
    codes = np.array([ord(c) for c in text], np.uint64)
    with np.errstate(over="ignore"):
        inner = syncmers._mix(syncmers._grams(codes + np.uint64(1), 5))
    want = [i for i in range(len(text) - 11) if min(inner[i: i + 8]) in (inner[i], inner[i + 7])]
    assert at.tolist() == want
    shifted, _ = syncmers.anchors("zz " + text, 12, 5)
    assert {i + 3 for i in want} <= set(shifted.tolist())


@pytest.mark.parametrize("chars", [1 << 24, 2000])
def test_successors(spark, odd, none, chars):
    rows = documents(spark)
    df = common.table(spark, SF, "documents")
    order = sorted(rows, reverse=True)
    want = {}
    for (d, t), (_, u) in zip(order, [*order[1:], order[0]]):
        e = syncmers.edited(t, u)
        a, b, c = map(syncmers.fingerprint, (t, e, u))
        want[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), syncmers.as_text(a), syncmers.as_text(b),
                   syncmers.likeness(a, b), syncmers.likeness(a, c))
    got = {r[0]: tuple(r[1:]) for r in syncmers.with_successors(df, chars).collect()}
    assert got == want
    assert syncmers.with_successors(odd, chars).count() == odd.count()
    assert syncmers.with_successors(none).count() == 0


# 3 decontamination

def plain_hits(text, items):
    word = re.compile(decontamination.WORD)
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    w, hit, ids = word.findall(low(text)), set(), set()
    for i, t in items:
        x = word.findall(low(t))
        n = min(10, len(x))
        grams = {tuple(x[k: k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if grams and tuple(w[k: k + n]) in grams:
                hit |= set(range(k, k + n))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids)


def test_decontamination_against_plain(spark, odd, none):
    rng = random.Random(4)
    vocabulary = ["a", "b", "C", "dé", "e1"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 5, 9, 10, 14]) if i else 12)) for i in range(9)] + [(9, None), (None, "zz zz")]
    docs = [(i, text(rng.randrange(60)) + rng.choice(["", " " + items[0][1] + " x", " zz, ZZ."])) for i in range(60)]
    docs += [(70, None), (71, docs[0][1]), (0, docs[1][1]), (5, docs[5][1]), (None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("kept", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in decontamination.decontaminate(d, b).collect()), key=key)
    # collect_set leaves out the NULL id; such an item still marks words.
    want = sorted(((i, *plain_hits(t, items)[:2], [x for x in plain_hits(t, items)[2] if x != "None"]) for i, t in docs), key=key)
    assert got == want
    clean = decontamination.clean(d, b)
    assert clean.count() == sum(w[2] == 0 for w in want) and clean.columns == d.columns
    assert decontamination.decontaminate(odd, b).count() == odd.count()
    assert decontamination.decontaminate(none, b).count() == 0
    assert decontamination.clean(odd, b.limit(0)).count() == odd.count()


# 4 SimHash

def test_simhash_bits():
    t = "One  two\tThree four five É"
    w = t.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i: i + 4]), 42) for i in range(3)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 3)
    assert simhash.fingerprint(t) & (2**64 - 1) == want
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


@pytest.mark.parametrize("block", [2048, 8])
def test_links_connect_all_within_distance(spark, block):
    rng = random.Random(6)
    fps = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(12):
            base ^= sum({1 << rng.randrange(64) for _ in range(rng.randrange(6))})
            fps.add(base - (1 << 64) if base >> 63 else base)
    fps = sorted(fps)
    got = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 4, block)
    pairs = {(r.a, r.b) for r in got.collect()}
    u = np.array(fps).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    label = list(range(len(fps)))
    for _ in fps:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(fps))]
        if new == label:
            break
        label = new
    roots = {r.node: r.root for r in common.connected(got, "t").collect()}
    assert all(near[fps.index(a), fps.index(b)] for a, b in pairs)
    assert [roots.get(f, f) for f in fps] == [fps[x] for x in label]


def test_simhash_dedup(spark, odd, none):
    out = simhash.dedup(odd)
    assert out.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in out.collect()]
    assert len(rows) == len(set(rows)) and ("same text twice" in [t for _, t in rows])
    assert sum(t == "same text twice" for _, t in rows) == 1
    assert simhash.dedup(none).count() == 0


# 5 secrets

def test_secret_spans(odd, none):
    base = lambda t: secrets.joined(secrets.base_spans(t))
    assert base('x api-key API_KEY = "abc123" y') == "assign:10:27"
    assert base("password=token: abcdefg") == ""  # the shorter match has used the word up
    assert base("AKIA" + "A" * 15 + " AKIA" + "B" * 16) == "access:20:40"
    assert base("é" + "a" * 24 + " " + "b" * 23) == "hex:1:25"
    path = secrets.public_tokenizers.path(secrets.VOCABULARY)
    found = lambda t, **o: [t[s:e] for s, _, e in secrets.random_spans(t, path, **o)]
    key, letters, digest = "q7Zp0Xv93LmTk2RwY8sBd4Hc", "QzXwVbNmKjHgFdSaPoIuYtRe", hashlib.sha1(b"x").hexdigest()
    assert found(f"use {key} now, or {letters}") == [key, letters]
    assert not found("some_long_identifier_2024 123e4567-e89b-12d3-a456-426614174000 internationalization")
    assert not found(f"sha1: {digest}") and not found(f'"Checksum": "{digest}"') and found(f"key {digest}") == [digest]
    assert not found(f"key {digest}", listed=frozenset([digest]))
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(none).count() == 0


def test_token_test_finds_secrets_and_leaves_clean_documents_alone():
    """Recall on assigned secrets by the token test alone; clean: without any fixed pattern."""
    import pyarrow.parquet as pq

    path = secrets.public_tokenizers.path(secrets.VOCABULARY)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    values = hit = clean = wrong = 0
    for t in texts:
        spans = secrets.random_spans(t, path)
        for m in secrets.ASSIGN.finditer(t):
            if len(m[2]) >= 20:
                values += 1
                hit += any(s <= m.start(2) and m.end(2) <= e for s, _, e in spans)
        if not secrets.base_spans(t):
            clean += 1
            wrong += bool(spans)
    assert values >= 10 and hit >= 0.9 * values and wrong <= 0.01 * clean, (values, hit, clean, wrong)


def test_secret_query_against_the_definition(spark):
    path = secrets.public_tokenizers.path(secrets.VOCABULARY)
    got = {r.doc_id: r for r in secrets.op5_secret_scan(spark, SF).collect()}
    for doc_id, text in documents(spark):
        base = {(m.start(), 0, m.end()) for m in re.finditer(
            r"""(?i:password|passwd|secret|token|api_?key)["']?[ ]*[:=][ ]*["']?([A-Za-z0-9+/_.=-]+)""", text or "") if len(m[1]) > 5}
        base |= {(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) > 19}
        base |= {(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) > 23}
        more = secrets.random_spans(text or "", path)
        show = lambda spans: ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
        r = got[doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(show(base).encode()).hexdigest()
        assert r.spans == show([*base, *more])


# 6 lines

def test_lines(spark, odd, none):
    rng = random.Random(8)
    lines = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(20, 60))) for _ in range(60)]
    for _ in range(80):
        t = list(rng.choice(lines))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(t))
            t[k: k + rng.randrange(2)] = rng.choice(["", "x", "é"])
        lines.append("".join(t))
    docs = [(i, "\n".join(rng.choice(lines) for _ in range(5))) for i in range(40)]
    distance = lambda a, b: _levenshtein(a, b) <= 2
    distinct = sorted({l for _, t in docs for l in t.split("\n") if len(l) >= 24})
    label = {l: l for l in distinct}
    changed = True
    while changed:
        changed = False
        for a in distinct:
            for b in distinct:
                if label[b] < label[a] and abs(len(a) - len(b)) <= 2 and distance(a, b):
                    label[a], changed = label[b], True
    seen, want = set(), {}
    for i, t in docs:
        keep = []
        for l in t.split("\n"):
            c = label.get(l)
            if c is None or c not in seen:
                keep.append(l)
            seen |= {c} - {None}
        want[i] = "\n".join(keep)
    got = linededup.clean(spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit(1)))
    assert {r.doc_id: r.text for r in got.collect()} == want
    assert linededup.clean(odd).count() == odd.count() and linededup.clean(none).count() == 0


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


# 7 urls

def test_urls(spark, none):
    urls = ["http://A.com/x?y", "https://www.example.com/en/1", "http://m.example.com/en/#", "//no", None, "",
            "http://shop.net/es/1", "http://shop.net", "ftp://net/fr/a/b", "http://evilcom/", "x://y.org?q://z.com/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    parts = df.select("page_id", urlfilter.host_of(F.col("url")).alias("host"), urlfilter.path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("r", urlfilter.rule_of(F.col("host"), F.col("path"))).select("page_id", "host", "path", "r.*").orderBy("page_id")
    got = [tuple(r)[1:] for r in ruled.collect()]
    assert got == [
        ("a.com", "/x", "com/", "allow"), ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("m.example.com", "/en/", "example.com/en/", "block"), ("", "", None, None), ("", "", None, None),
        ("", "", None, None), ("shop.net", "/es/1", "net/es/", "block"), ("shop.net", "", None, None),
        ("net", "/fr/a/b", "net/fr/", "block"), ("evilcom", "/", None, None), ("y.org", "", None, None)]
    model = urlfilter.fit(ruled.where("verdict is not null"))
    assert {r.verdict for r in urlfilter.judge(ruled, model).collect()} <= {"allow", "block"}
    assert urlfilter.fit(ruled.limit(0)).blocked("a.com", "/") < 0.5


def test_url_model_learns(spark):
    rng = random.Random(1)
    rows = [(f"{rng.choice(['win', 'casino', 'bet'])}{i}.org", f"/{i}", "block") for i in range(200)]
    rows += [(f"{rng.choice(['news', 'school', 'museum'])}{i}.org", f"/{i}", "allow") for i in range(200)]
    model = urlfilter.fit(spark.createDataFrame(rows, "host string, path string, verdict string"))
    held = [("casino9999.org", "/7", True), ("museum9999.org", "/7", False), ("bet777777.org", "/", True)]
    assert all((model.blocked(h, p) >= 0.5) == x for h, p, x in held)


# 8 packing

def test_cuts_add_up():
    for n in range(1, 5000):
        c = packing.cuts(n)
        assert sum(c) == n and all(0 < x <= 1024 for x in c)


def test_packing(spark, odd, none):
    df = common.table(spark, SF, "documents").select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = packing.pack(df).collect()
    by, ids = defaultdict(list), {}
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    joined = defaultdict(list)
    for r in rows:
        joined[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for (_, n), parts in joined.items():  # the pieces of a document join, once for each copy of it
        copies = sum(start == 0 for start, _ in parts)
        at = 0
        for start, length in sorted(set(parts)):
            assert start == at and parts.count((start, length)) == copies
            at += length
        assert at == n
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(packing.public_tokenizers.path(packing.VOCABULARY))
    texts = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect() if r.doc_id > 20}
    for r in rows:
        if r.doc_id in texts:
            if r.doc_id not in ids:
                ids[r.doc_id] = np.array(t.encode(texts[r.doc_id], add_special_tokens=False).ids + [0], "<u4")
            piece = ids[r.doc_id][r.start: r.start + r.length]
            assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(piece.tobytes())
    assert packing.pack(none).count() == 0


def test_packing_leaves_little_padding(spark):
    rows = packing.op8_harmonic_packing(spark, "/root/testdata/sf0.01").select("sequence_id", "length").collect()
    sequences = 1 + max(r.sequence_id for r in rows)
    assert sum(r.length for r in rows) >= 0.94 * 1024 * sequences


def test_encoder_is_the_library():
    e = packing.Encoder(packing.public_tokenizers.path(packing.VOCABULARY), packing.public_tokenizers.path(packing.RANKS))
    odd = ["a  b", " lead", "trail ", "x ", " x y ", "a\n b\n\nc", "x<|endoftext|>y z", "tab\t x \x1c y   z", "  a  　b",
           "it's  they'll 12 34", "", " ", "  ", "a \u0085 b", "\0 a b", "a \0b", "a b\n", "\na b", "é" * 99 + " b"]
    odd += [t or "" for _, t in map(tuple, pq_rows("/root/testdata/sf0.001/documents.parquet"))]
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(b, "<u4").tolist() for b in e.encode(odd)]
        assert got == [x.ids for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]


def test_sequences_are_padded(spark):
    df = spark.createDataFrame([(i, "word " * n) for i, n in enumerate([900, 5, 5, 5, 300, 300])], "doc_id long, text string")
    cut = common.materialize(packing.pieces(df), "cut")
    for r in packing.sequences(packing.place(cut)).collect():
        assert len(r["ids"]) == 1024 or len(r["ids"]) & (len(r["ids"]) - 1) == 0


# 10 languages

def test_language_id(spark, odd, none):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.train(docs, langid.fold(3) != 1)
    held = langid.predict(docs.where(langid.fold(3) == 1), model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in held) / len(held) < 0.02
    got = {r.text: r for r in langid.predict(odd, model, ["text"]).collect()}
    assert all(got[t].lang_pred == "und" and got[t].rejected for t in (None, "", " \n\t", "\n\n"))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.predict(none, model, ["doc_id"]).count() == 0
    assert langid.train(none, F.lit(True)).predict("abc") == ("und", 0.0, True)


# pipeline

def test_pipeline(spark, odd):
    docs = common.table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, SF), "stage")
        if name != "packing":
            assert out.columns == columns and 0 < out.count() <= docs.count()
            docs = out
        else:
            assert {r.doc_id for r in out.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF).count() >= 0
        assert stage(spark, odd.limit(0), SF).count() == 0
    assert corpus_pipeline.run(spark, SF).count() == out.count()
